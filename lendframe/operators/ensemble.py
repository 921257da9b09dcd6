"""Ensemble of prediction sets and the stated-amount override."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.operators.amount import DESC, trusted_amount


def ensemble_mean(predictions: DataFrame, out_col: str = "LOAN_AMOUNT",
                  n_models: int | None = None) -> DataFrame:
    """(LOAN_ID, mean prediction) over all prediction sets.

    Input rows are (model_id, LOAN_ID, LOAN_AMOUNT), one per set and loan.  A
    loan missing from a set, or with a missing value in it, gets null, as
    adding a missing value would.  Keyed by LOAN_ID, so the
    order of the sets and of the rows does not matter; the group-by runs with
    map-side partial aggregation.

    ``n_models`` is the number of prediction sets when the caller knows it
    (the number of files read); otherwise it is counted from the data, which
    costs one more pass over the predictions.
    """
    if n_models is None:
        n_models = predictions.select(F.countDistinct("model_id")).scalar()
    else:
        n_models = F.lit(n_models)
    return (predictions.groupBy("LOAN_ID")
            .agg(F.avg("LOAN_AMOUNT").alias("_mean"), F.count("LOAN_AMOUNT").alias("_k"))
            .select("LOAN_ID", F.when(F.col("_k") == n_models, F.col("_mean")).alias(out_col)))


def corrected_submission(scaffold: DataFrame, mean: DataFrame, desc: DataFrame,
                         test: DataFrame | None = None, currencies=None) -> DataFrame:
    """(LOAN_ID, LOAN_AMOUNT): the ensemble mean, replaced by the stated USD
    amount where one was found and the currency is trusted.

    ``scaffold`` lists the loans to submit (LOAN_ID), ``desc`` the converted
    stated amounts (LOAN_ID, CURRENCY, LOAN_AMOUNT_DESC).  The currency is
    taken from ``test`` when given, else from ``desc``.  All joins are left
    joins on the unique LOAN_ID.
    """
    out = scaffold.select("LOAN_ID").join(mean, "LOAN_ID", "left")
    if test is not None:
        out = (out.join(test.select("LOAN_ID", "CURRENCY"), "LOAN_ID", "left")
               .join(desc.select("LOAN_ID", DESC), "LOAN_ID", "left"))
    else:
        out = out.join(desc.select("LOAN_ID", "CURRENCY", DESC), "LOAN_ID", "left")
    out = trusted_amount(out, currencies)
    return out.select("LOAN_ID", F.coalesce(F.col(DESC), F.col("LOAN_AMOUNT")).alias("LOAN_AMOUNT"))
