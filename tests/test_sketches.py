"""Rates from stored sketches against the exact median."""

import os

from conftest import SF_SMALL
from pyspark.sql import functions as F

from lendframe.operators import amount as A
from lendframe.sources import fixtures as fx


def test_rank_of_the_sketched_median_is_within_the_bound(spark):
    base = spark.range(40_000).select(F.col("id").alias("LOAN_ID"), (F.col("id") % 3).cast("string").alias("CURRENCY"), F.rand(7).alias("rate"))
    base = base.cache()
    found = {r.CURRENCY: r for r in A.sketched_median_rate(A.rate_sketches(base, 1000)).collect()}
    for currency, r in found.items():
        own = base.where(F.col("CURRENCY") == currency)
        rank = own.where(F.col("rate") <= r.rate).count() / own.count()
        assert r.n == own.count() and abs(rank - 0.5) <= 4 * A.SKETCH_RANK_ERROR
    base.unpersist()


def test_a_new_day_adds_parts_and_reads_no_old_loans(spark, scratch):
    base = A.rate_base(A.extract_local_amount(fx.loan(spark, SF_SMALL), 1, keep=["LOAN_AMOUNT"]))
    path = os.path.join(scratch, "sketches")
    A.rate_sketches(base.where("LOAN_ID < 700"), 100).write.partitionBy("part").parquet(path)
    A.rate_sketches(base.where("LOAN_ID >= 700"), 100).write.mode("append").partitionBy("part").parquet(path)
    stored = spark.read.parquet(path)
    at_once = A.rate_sketches(base, 100)
    assert stored.groupBy("CURRENCY").agg(F.sum("n")).exceptAll(at_once.groupBy("CURRENCY").agg(F.sum("n"))).count() == 0
    exact = {r.CURRENCY: r.rate for r in A.median_rate(A.extract_local_amount(fx.loan(spark, SF_SMALL), 1, keep=["LOAN_AMOUNT"])).collect()}
    rates = {r.CURRENCY: r.rate for r in A.sketched_median_rate(stored).collect()}
    assert set(rates) == set(exact)  # few rates: the sketch holds them all, and gives one of the two middle ones
    recent = {r.CURRENCY: r.n for r in A.sketched_median_rate(stored, min_part=7).collect()}
    known = base.where("LOAN_ID >= 700 and rate is not null").groupBy("CURRENCY").count().collect()
    assert recent == {r.CURRENCY: r["count"] for r in known}
