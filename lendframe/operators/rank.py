"""Order statistics without a hot task.

A plain ``row_number().over(Window.orderBy(...))`` runs in one task, and
``Window.partitionBy(g)`` or an exact ``median`` runs each group in one task:
if one group holds a third of all rows, that task holds a third of the data.
The operators here range-partition on (group, order) instead.  The sampled
range bounds split a large group over many partitions, each partition works
on its own slice, and a table with one row per (partition, group) carries
the offsets between slices.  That table has at most P + G rows (P partitions,
G groups), because each partition holds a contiguous key range.

Everything is DataFrame API: a range exchange, local sorts or windows over
bounded slices, small aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOCAL_BITS = 33  # monotonically_increasing_id = (partition << 33) + row


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _materialize(df: DataFrame) -> DataFrame:
    """Written once below the shared checkpoint folder and read back (deleted when the program ends)."""
    from lendframe.sources.tables import write_and_read
    return write_and_read(df, "ranked")


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def with_global_index(df: DataFrame, order_cols, index_col: str = "idx",
                      num_partitions: int | None = None) -> DataFrame:
    """Add a 0-based position in the total order of ``order_cols``.

    Equal keys may take their positions in any order among themselves.
    """
    p = _num_partitions(df, num_partitions)
    order = _cols(order_cols)
    r = (df.repartitionByRange(p, *order).sortWithinPartitions(*order)
         .withColumn("_mid", F.monotonically_increasing_id()))
    # The per-partition counts and the rows must come from the same range
    # partitioning.  A range exchange samples its bounds each time it runs
    # (the seed depends on the RDD id), so the tagged rows are written once
    # to the checkpoint folder and both branches read that copy.
    r = _materialize(r)
    pid = F.shiftright(F.col("_mid"), _LOCAL_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    r = r.withColumn("_pid", pid)
    # One row per partition: at most P rows, so broadcasting it is safe.
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    return (r.join(F.broadcast(offsets), "_pid")
            .withColumn(index_col, F.col("_off") + local)
            .drop("_mid", "_pid", "_off"))


def exact_median(df: DataFrame, group_col: str, value_col: str, out_col: str = "median",
                 num_partitions: int | None = None) -> DataFrame:
    """Exact median per group, nulls skipped; with an even count the mean of
    the two middle values, ``(a + b) / 2``.  Groups with no value are absent.

    Equal values of a group are counted first (combined before the shuffle),
    so a value that a third of the rows share is one row.  The distinct values
    are range-partitioned on (group, value); running counts over them
    (``running_totals``) find the one or two middle values.
    """
    counted = df.where(F.col(value_col).isNotNull()).groupBy(group_col, value_col).agg(F.count(F.lit(1)).alias("_c"))
    run = running_totals(counted, [group_col], [value_col], ["_c"], prefix="_upto", num_partitions=num_partitions)
    totals = counted.groupBy(F.col(group_col).alias("_g")).agg(F.sum("_c").alias("_n"))
    upto = F.col("_upto_c")
    placed = run.join(totals, F.col(group_col).eqNullSafe(F.col("_g")))
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    middle = placed.where((upto > low) & (upto - F.col("_c") <= high))
    return middle.groupBy(group_col).agg(((F.min(value_col) + F.max(value_col)) / 2).alias(out_col))


def running_totals(df: DataFrame, group_cols, order_cols, value_cols, prefix: str = "run_",
                   num_partitions: int | None = None, eager: bool = True) -> DataFrame:
    """Running count and running sums of ``value_cols`` within each group,
    in ``order_cols`` order, current row included.

    Adds ``{prefix}n`` and ``{prefix}{v}`` for each value column.  With
    ``eager`` the input is persisted while the range exchange samples and
    shuffles it (see ``exact_median``), then released.
    """
    from pyspark import StorageLevel

    p = _num_partitions(df, num_partitions)
    groups = list(group_cols)
    order = _cols(order_cols)
    src = df.persist(StorageLevel.MEMORY_AND_DISK) if eager else df
    r = src.repartitionByRange(p, *_cols(groups), *order).withColumn("_pid", F.spark_partition_id())
    w = (Window.partitionBy("_pid", *groups).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = r.select("*", F.count(F.lit(1)).over(w).alias("_ln"),
                 *[F.sum(v).over(w).alias(f"_l_{v}") for v in value_cols])
    # Totals and rows must see the same range partitioning (see
    # with_global_index): write the tagged rows once.
    r = _materialize(r)
    if eager:
        src.unpersist()
    # One row per (range partition, group): at most P + G rows.
    totals = r.groupBy("_pid", *groups).agg(
        F.count(F.lit(1)).alias("_tn"), *[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid", *groups,
        F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_on"),
        *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    o = offsets.alias("_o")
    cond = F.col("_r._pid") == F.col("_o._pid")
    for g in groups:  # null-safe: a null group is a group too
        cond = cond & F.col(f"_r.{g}").eqNullSafe(F.col(f"_o.{g}"))
    out = r.alias("_r").join(o, cond)
    out = out.select(
        *[F.col(f"_r.{c}") for c in df.columns],
        (F.col("_on") + F.col("_ln")).alias(f"{prefix}n"),
        *[(F.col(f"_o_{v}") + F.col(f"_l_{v}")).alias(f"{prefix}{v}") for v in value_cols])
    return out
