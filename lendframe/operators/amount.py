"""Stated amounts: find the amount a borrower writes in local currency,
infer each currency's rate from past loans and convert it to USD.

Two extractors exist:

* v1: split on every ".", keep sentences naming the currency, drop commas,
  take every integer;
* v2: turn ``<br />`` into a space, split on ". ", append a space to every
  sentence, keep sentences naming the currency and take numbers written right
  next to the code (see ``AMOUNT_NUMBER_FORMS``).

The original searched every currency over all sentences in a loop, then kept
a loan's rows for its own currency only.  Searching each sentence once with
its own loan's currency is the same result in one pass, and taking the
maximum inside the row (array functions) needs no explode and no group-by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.functions import text as T
from lendframe.functions.fixed import TRUSTED_CURRENCIES
from lendframe.operators.rank import exact_median

LOCAL = "LOAN_AMOUNT_LOCAL"
DESC = "LOAN_AMOUNT_DESC"


def extract_local_amount(loans: DataFrame, version: int = 2, keep=()) -> DataFrame:
    """(LOAN_ID, CURRENCY, LOAN_AMOUNT_LOCAL, *keep): the largest amount
    stated in the (filled) description, null when none is stated.  ``keep``
    passes columns through (e.g. LOAN_AMOUNT, to build the rate base without
    joining the loans back)."""
    text = T.fill_description()
    sentences = T.sentences_v2(text) if version == 2 else T.sentences_v1(text)
    return loans.select("LOAN_ID", "CURRENCY", *keep,
                        T.max_stated_amount(sentences, F.col("CURRENCY"), version).alias(LOCAL))


def sentence_rows(loans: DataFrame, version: int = 2) -> DataFrame:
    """One row per sentence: (LOAN_ID, CURRENCY, sentence_no, sentence)."""
    text = T.fill_description()
    sentences = T.sentences_v2(text) if version == 2 else T.sentences_v1(text)
    return loans.select("LOAN_ID", "CURRENCY",
                        F.posexplode(sentences).alias("sentence_no", "sentence"))


def sentences_with_currency(loans: DataFrame) -> DataFrame:
    s = sentence_rows(loans, 2)
    return s.where(F.contains(F.col("sentence"), F.col("CURRENCY")))


def rate_base(local: DataFrame, train: DataFrame | None = None, min_loan_id: int | Column | None = None) -> DataFrame:
    """(LOAN_ID, CURRENCY, rate): local / USD of each training loan (see ``median_rate``)."""
    if train is None:
        base = local.where(F.col("LOAN_AMOUNT").isNotNull())
    else:
        base = local.join(train.select("LOAN_ID", "LOAN_AMOUNT"), "LOAN_ID")
    if min_loan_id is not None:
        base = base.where(F.col("LOAN_ID") > (min_loan_id if isinstance(min_loan_id, Column) else F.lit(min_loan_id)))
    return base.select("LOAN_ID", "CURRENCY", F.try_divide(F.col(LOCAL), F.col("LOAN_AMOUNT")).alias("rate"))


#: Size parameter of the rate sketches, and the rank error (share of a currency's loans) their
#: medians stay within with a probability of about 99 %.
SKETCH_K = 800
SKETCH_RANK_ERROR = 0.0035


def rate_sketches(base: DataFrame, id_span: int, k: int = SKETCH_K) -> DataFrame:
    """(CURRENCY, part, n, sketch): a KLL sketch of the rates of each currency and range of ``id_span`` loan ids.

    The rates of a part meet before they are sketched: a part is small, and a sketch in each task
    that holds some of its loans would be nearly a sketch a loan.  Sketches merge: store them (sorted
    by part, see ``write_rate_sketches``), and newer loans add new parts without reading older loans again."""
    part = F.floor(F.col("LOAN_ID") / F.lit(id_span)).cast("bigint")
    known = base.where(F.col("rate").isNotNull()).select("CURRENCY", part.alias("part"), "rate")
    return known.repartition("part").groupBy("CURRENCY", "part").agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("rate", F.lit(k)).alias("sketch"))


def write_rate_sketches(sketches: DataFrame, path: str) -> None:
    """Append sketches to a store (Parquet), sorted by part: a reader of some parts skips the row
    groups of others.  A folder for each part would be as many as there are spans of loan ids."""
    sketches.sortWithinPartitions("part").write.mode("append").parquet(path)


def sketched_median_rate(sketches: DataFrame, min_part: int | Column | None = None, k: int = SKETCH_K) -> DataFrame:
    """(CURRENCY, n, rate) from stored sketches, optionally of parts from ``min_part`` on: a rate whose
    rank is within about ``SKETCH_RANK_ERROR`` of the median's."""
    if min_part is not None:
        sketches = sketches.where(F.col("part") >= min_part)
    merged = sketches.groupBy("CURRENCY").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    return merged.select("CURRENCY", "n", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("rate"))


def median_rate(local: DataFrame, train: DataFrame | None = None, min_loan_id: int | Column | None = None,
                num_partitions: int | None = None, approx_accuracy: int | None = None) -> DataFrame:
    """(CURRENCY, rate): median over training loans of local / USD.

    The USD amount comes from ``train`` (joined on LOAN_ID) or, when
    ``train`` is None, from a LOAN_AMOUNT column of ``local`` itself (null
    for test loans).  ``min_loan_id`` keeps only newer loans (ids above it),
    for a rate close to the prediction period.  Exact median, split across
    tasks when one currency dominates.  With ``approx_accuracy`` the median
    is ``percentile_approx`` instead: a mergeable sketch per currency,
    partially aggregated before the shuffle (one pass, no range exchange),
    with rank error about 1 / accuracy of the group size.
    """
    base = rate_base(local, train, min_loan_id).drop("LOAN_ID")
    if approx_accuracy:
        return (base.where(F.col("rate").isNotNull()).groupBy("CURRENCY")
                .agg(F.percentile_approx("rate", 0.5, approx_accuracy).alias("rate")))
    return exact_median(base, "CURRENCY", "rate", "rate", num_partitions)


def convert_usd(local: DataFrame, rate: DataFrame) -> DataFrame:
    """(LOAN_ID, CURRENCY, LOAN_AMOUNT_DESC) = local amount / currency rate.

    A zero rate gives null (not infinity), so such a loan keeps its model
    prediction.  The rate table has one row per currency.
    """
    keep = [c for c in local.columns if c not in ("LOAN_ID", "CURRENCY", LOCAL)]
    # One row per currency: the planner broadcasts it by its measured size.
    return (local.join(rate, "CURRENCY", "left")
            .select("LOAN_ID", "CURRENCY", *keep, F.try_divide(F.col(LOCAL), F.col("rate")).alias(DESC)))


def amount_feature(desc: DataFrame, y_log_mean, y_log_std, keep=()) -> DataFrame:
    """(LOAN_ID, *keep, LOAN_AMOUNT_DESC_LOG_Z, LOAN_AMOUNT_DESC_LOG_Z_isna).

    The feature is ln(amount + 1) scaled with the statistics of ln(target)
    (not of ln(target + 1)); missing becomes 0 with an indicator of 1.
    """
    z = (F.ln(F.col(DESC) + F.lit(1.0)) - y_log_mean) / y_log_std
    return desc.select(
        "LOAN_ID", *keep,
        F.coalesce(z, F.lit(0.0)).alias("LOAN_AMOUNT_DESC_LOG_Z"),
        z.isNull().cast("int").alias("LOAN_AMOUNT_DESC_LOG_Z_isna"))


def trusted_amount(desc_with_currency: DataFrame, currencies=None) -> DataFrame:
    """Null out the stated amount unless the currency is trusted."""
    cur = currencies or TRUSTED_CURRENCIES
    return desc_with_currency.withColumn(
        DESC, F.when(F.col("CURRENCY").isin(*cur), F.col(DESC)))
