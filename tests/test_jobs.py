"""The end-to-end file jobs give what the registered queries give."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lendframe.plans import jobs
from lendframe.plans.queries import QUERIES
from lendframe.sources import files as FILES
from lendframe.sources import fixtures as fx


def _write_inputs(spark, scratch):
    loans = fx.loan(spark, SF_SMALL)
    train_p, test_p = os.path.join(scratch, "train.csv"), os.path.join(scratch, "test.csv")
    FILES.write_loans_csv(fx.train(loans).select(*FILES.LOAN_COLUMNS), train_p)
    FILES.write_loans_csv(fx.test(loans).select(*[c for c in FILES.LOAN_COLUMNS if c != "LOAN_AMOUNT"]), test_p)
    sample_p = os.path.join(scratch, "sample_submission.csv")
    FILES.write_csv(fx.test(loans).select("LOAN_ID", F.lit(0.0).alias("LOAN_AMOUNT")), sample_p)
    preds = fx.predictions(spark, SF_SMALL, fx.test(loans)).toPandas()
    paths = []
    for k, part in preds.groupby("model_id"):
        p = os.path.join(scratch, f"model_{k:02d}.csv")
        part[["LOAN_ID", "LOAN_AMOUNT"]].to_csv(p, index=False)
        paths.append(p)
    return train_p, test_p, sample_p, paths


def test_submission_job_equals_the_flagship_query(spark, scratch):
    train_p, test_p, sample_p, paths = _write_inputs(spark, scratch)
    out = jobs.submission_job(spark, train_p, test_p, sample_p, paths, os.path.join(scratch, "submission"),
                              recent_loan_id=fx.recent_cutoff(spark, SF_SMALL))
    got = {r["LOAN_ID"]: round(r["LOAN_AMOUNT"], 4)
           for r in spark.read.option("header", True).schema("LOAN_ID long, LOAN_AMOUNT double").csv(out).collect()}
    want = {r["LOAN_ID"]: r["LOAN_AMOUNT"] for r in QUERIES["corrected_submission"](spark, SF_SMALL).collect()}
    assert got == want and len(got) == 300


def test_stated_amount_job_equals_the_feature_query(spark, scratch):
    train_p, test_p, _, _ = _write_inputs(spark, scratch)
    out = jobs.stated_amount_job(spark, train_p, test_p, os.path.join(scratch, "feature"))
    schema = "LOAN_ID long, LOAN_AMOUNT_DESC_LOG_Z double, LOAN_AMOUNT_DESC_LOG_Z_isna int"
    rows = []
    for name in ("train", "test"):
        rows += spark.read.option("header", True).schema(schema).csv(out[name]).collect()
    got = {r["LOAN_ID"]: (round(r[1], 6), r[2]) for r in rows}
    want = {r["LOAN_ID"]: (r[1], r[2]) for r in QUERIES["amount_feature"](spark, SF_SMALL).collect()}
    assert got == want and len(got) == 1500


def test_jobs_read_the_parquet_copy_too(spark, scratch):
    train_p, test_p, sample_p, paths = _write_inputs(spark, scratch)
    train_q = os.path.join(scratch, "train.parquet")
    test_q = os.path.join(scratch, "test.parquet")
    FILES.csv_to_parquet(spark, train_p, train_q, with_target=True)
    FILES.csv_to_parquet(spark, test_p, test_q, with_target=False)
    a = jobs.submission_job(spark, train_p, test_p, sample_p, paths, os.path.join(scratch, "a"), 500)
    b = jobs.submission_job(spark, train_q, test_q, sample_p, paths, os.path.join(scratch, "b"), 500)
    schema = "LOAN_ID long, LOAN_AMOUNT double"
    ra = spark.read.option("header", True).schema(schema).csv(a)
    rb = spark.read.option("header", True).schema(schema).csv(b)
    assert ra.count() == 300 and ra.exceptAll(rb).count() == 0 and rb.exceptAll(ra).count() == 0


def test_a_training_loan_with_a_bad_target_stays_a_training_loan(spark, scratch):
    loans = fx.loan(spark, SF_SMALL).where("LOAN_ID <= 60")
    train = fx.train(loans).select(*FILES.LOAN_COLUMNS)
    bad = train.agg(F.min("LOAN_ID")).first()[0]
    train = train.withColumn("LOAN_AMOUNT", F.when(F.col("LOAN_ID") == bad, "12O0").otherwise(F.col("LOAN_AMOUNT").cast("string")))
    test = fx.test(loans).select(*[c for c in FILES.LOAN_COLUMNS if c != "LOAN_AMOUNT"])
    train_p, test_p = os.path.join(scratch, "train.csv"), os.path.join(scratch, "test.csv")
    FILES.write_loans_csv(train, train_p)
    FILES.write_loans_csv(test, test_p)
    out = jobs.stated_amount_job(spark, train_p, test_p, os.path.join(scratch, "out"))
    ids = {k: {r["LOAN_ID"] for r in spark.read.option("header", True).option("inferSchema", True).csv(p).collect()} for k, p in out.items()}
    assert bad in ids["train"] and len(ids["train"]) == train.count() and len(ids["test"]) == test.count()
