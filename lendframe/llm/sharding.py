"""Shuffled shards by a two-pass external shuffle, with DataFrame functions only.

Pass 1 scatters the records uniformly, by a seeded hash of the row, into
buckets of about ``bucket_bytes`` (so many buckets as the total size asks
for).  Pass 2 holds one bucket at a time in memory, permutes it (``shuffle``
is a Fisher-Yates shuffle of an array), and numbers its records on from the
buckets before it.  The shards are consecutive runs of that order: law
``rows``, any two shards differ by at most one record.

A bucket holds a uniform share of the rows, whatever the sources or keys
are; only one record can be larger than a bucket.  The running count over
buckets is one small row per bucket.  Edge cases: null text has no bytes;
repeated rows are dealt like any other; fewer records than shards leave some
shards empty; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

RECORD_BYTES = 8


def record_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def shuffle_into_shards(docs: DataFrame, n_shards: int = 24, bucket_bytes: int = 8 << 20, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` plus ``shard`` (int) and ``slot`` (long, gapless
    from 0 in each shard).  Clashing columns of the input are replaced."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    total = docs.agg(F.sum(record_size(F.col("text"))).alias("n")).first()["n"] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(n_buckets))

    ends = Window.orderBy("bucket")
    counts = docs.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "bucket", (F.sum("n").over(ends) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))

    record = F.struct(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("text")).alias("order"), F.struct(*columns).alias("record"))
    scattered = docs.select(bucket.alias("bucket"), record.alias("r")).groupBy("bucket").agg(F.collect_list("r").alias("rs"))
    arranged = F.array_sort("rs", lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0))
    permuted = scattered.join(offsets.hint("merge"), "bucket").select(
        "before", "all", F.posexplode(F.shuffle(arranged, F.lit(seed))).alias("i", "r"))
    at = F.col("before") + F.col("i")
    shard = F.floor((F.lit(n_shards) * (at + 1) - 1) / F.col("all"))
    return permuted.select(
        *[F.col("r.record")[c].alias(c) for c in columns], at.alias("at"), "all", shard.alias("s")).select(
        *columns, F.col("s").cast("int").alias("shard"),
        (F.col("at") - F.floor(F.col("s") * F.col("all") / n_shards)).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, n_shards: int = 24) -> None:
    """One folder per shard, records in slot order within each file."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
