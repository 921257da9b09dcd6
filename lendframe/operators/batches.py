"""Mini-batches: a new order of all rows for each epoch, and ordered batches
for prediction.

An epoch's order is that of a seeded hash of (seed, epoch, key): it is the same on
every rerun and any cluster, and differs between epochs.  Rows are numbered
over range partitions of (epoch, hash), so no task holds an epoch and
every batch but an epoch's last has exactly ``batch_size`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.operators.rank import running_totals, with_global_index


def epoch_order(key: Column, epoch: Column, seed: int = 0) -> Column:
    """What an epoch is ordered by: an md5, equal in any engine that has it."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("null"))))


def epoch_batches(rows: DataFrame, key: str, epochs: Sequence[int], batch_size: int, seed: int = 0,
                  num_partitions: int | None = None) -> DataFrame:
    """(epoch, batch, slot, *columns of rows): every row once in every epoch;
    batches and slots from 0.  Rows of one key lie next to each other."""
    clash = {"epoch", "batch", "slot"} & set(rows.columns)
    if clash:
        raise ValueError(f"columns clash with those of the batches: {sorted(clash)}")
    each = rows.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in epochs])))
    each = each.withColumn("_order", epoch_order(F.col(key), F.col("epoch"), seed))
    placed = running_totals(each, ["epoch"], ["_order", key], [], prefix="_run_", num_partitions=num_partitions)
    at = F.col("_run_n") - 1
    return placed.select("epoch", F.floor(at / batch_size).cast("bigint").alias("batch"), (at % batch_size).cast("bigint").alias("slot"), *rows.columns)


def ordered_batches(rows: DataFrame, key: str, batch_size: int, num_partitions: int | None = None) -> DataFrame:
    """(batch, slot, *columns of rows) in the order of ``key``, for prediction."""
    clash = {"batch", "slot"} & set(rows.columns)
    if clash:
        raise ValueError(f"columns clash with those of the batches: {sorted(clash)}")
    placed = with_global_index(rows, [key], "_at", num_partitions)
    return placed.select(F.floor(F.col("_at") / batch_size).cast("bigint").alias("batch"), (F.col("_at") % batch_size).cast("bigint").alias("slot"), *rows.columns)
