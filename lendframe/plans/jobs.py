"""End-to-end jobs over the original file layout.

The original runs as scripts that read loan CSV files and write CSV files.
These are the same jobs on Spark, for a user switching over:

* ``stated_amount_job``: train and test loans -> the stated-amount feature
  (z-score and missing flag) per loan, one output for each set;
* ``submission_job``: train and test loans, the sample submission and the
  prediction files -> the corrected submission.

Inputs may be CSV (read with the null tokens of a default CSV reader) or
parquet (``*.parquet``); multi-line CSV cannot be split inside a file, so
convert large inputs once with ``sources.files.csv_to_parquet``.
"""

from __future__ import annotations

import warnings

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.functions.fixed import RECENT_LOAN_ID
from lendframe.operators import amount as A
from lendframe.operators import ensemble as E
from lendframe.operators import target as TG
from lendframe.sources import files as FILES


def read_loans(spark: SparkSession, path: str, with_target: bool) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return FILES.read_loans_csv(spark, path, with_target)


def _both(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sets with ``is_train`` by their source: a training loan whose
    target does not parse stays a training loan.  Loans without a readable
    LOAN_ID are reported and left out: nothing can be keyed to them."""
    both = train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)), allowMissingColumns=True)
    lost = both.where(F.col("LOAN_ID").isNull()).count()
    if lost:
        warnings.warn(f"{lost} loans have no readable LOAN_ID and are left out", stacklevel=2)
    return both.where(F.col("LOAN_ID").isNotNull())


def stated_amount_job(spark: SparkSession, train_path: str, test_path: str, out_dir: str) -> dict:
    """Writes ``{out_dir}/train`` and ``{out_dir}/test`` as CSV with
    (LOAN_ID, LOAN_AMOUNT_DESC_LOG_Z, LOAN_AMOUNT_DESC_LOG_Z_isna).

    v1 amounts, a median rate over all training loans, ln(amount + 1) scaled
    by the statistics of ln(target) of the training loans.
    """
    train = read_loans(spark, train_path, True)
    test = read_loans(spark, test_path, False)
    local = A.extract_local_amount(_both(train, test), version=1, keep=["LOAN_AMOUNT", "is_train"])
    # Read by the rate and by the conversion: extract once.
    local = local.persist(StorageLevel.MEMORY_AND_DISK)
    desc = A.convert_usd(local, A.median_rate(local))
    mean, std = TG.stat_columns(train)
    feat = A.amount_feature(desc, mean, std, keep=["is_train"])
    out = {}
    for name, flag in (("train", True), ("test", False)):
        path = f"{out_dir.rstrip('/')}/{name}"
        FILES.write_csv(feat.where(F.col("is_train") == F.lit(flag)).drop("is_train"), path)
        out[name] = path
    local.unpersist()
    return out


def submission_job(spark: SparkSession, train_path: str, test_path: str, sample_submission_path: str,
                   prediction_paths: list[str], out_path: str,
                   recent_loan_id: int = RECENT_LOAN_ID) -> str:
    """Mean of the prediction files over the sample submission's loans,
    replaced by the stated USD amount where it was found and the currency is
    trusted.  The rate is the median over training loans newer than
    ``recent_loan_id``.  Writes (LOAN_ID, LOAN_AMOUNT) as CSV."""
    train = read_loans(spark, train_path, True)
    test = read_loans(spark, test_path, False)
    local = A.extract_local_amount(_both(train, test), version=2, keep=["LOAN_AMOUNT", "is_train"])
    local = local.persist(StorageLevel.MEMORY_AND_DISK)
    desc = A.convert_usd(local, A.median_rate(local, min_loan_id=recent_loan_id))
    scaffold = spark.read.option("header", True).schema("LOAN_ID long, LOAN_AMOUNT double").csv(
        sample_submission_path).select("LOAN_ID")
    preds = FILES.read_predictions(spark, prediction_paths)
    mean = E.ensemble_mean(preds, n_models=len(prediction_paths))
    out = E.corrected_submission(scaffold, mean, desc.where(~F.col("is_train")), test=test)
    FILES.write_csv(out, out_path)
    local.unpersist()
    return out_path
