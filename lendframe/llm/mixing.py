"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source's target is its share of all words by weight, limited to
``max_epochs`` times its own size; what is above is shared again by weight
until none is above.  In closed form: sort the sources by limit / weight; the
first i sources of that order are at their limit, and all others get one
common amount per unit of weight.

Within a source the words taken are complete epochs (every document, as often
as the target holds the whole source) and then one fractional epoch: documents
in the order of their exponential keys -ln(u) / quality weight (u is a hash of
the document, so reruns agree; the smallest keys are a weighted sample without
replacement), as far as the budget goes.  The document that crosses the budget
is taken if that ends nearer to it.

Scale: the keys are cut into ``buckets`` equal parts of their range.  Word
sums per (source, bucket) are aggregated before the shuffle, and only the one
bucket of each source in which the budget ends is ever sorted; documents in
earlier buckets are taken, later ones not.  A source with a third of all rows
sorts 1 / ``buckets`` of them.

Edge cases: null text has no words; a document without words takes none; the
null source is a source of its own, the last; with no words at all every
target is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lendframe.llm.common import stage

WEIGHTS = (5.0, 2.0, 1.0)
#: Sampling weight of a document by its quality label; without label 1.
QUALITY_WEIGHT = {1: 2.0, 0: 0.5}


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """source, source_size, target of a table (source, size)."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = per_source.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int"))).withColumn(
        "most", (F.col("source_size") * max_epochs).cast("double"))
    all_rows = Window.partitionBy()
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    levels = weighed.select(
        "*", F.sum("source_size").over(all_rows).cast("double").alias("total"),
        (F.sum("w").over(all_rows) - F.sum("w").over(fill) + F.col("w")).alias("w_left"),
        (F.sum("most").over(fill) - F.col("most")).alias("filled"))
    level = (F.col("total") - F.col("filled")) / F.col("w_left")
    free = levels.withColumn("level", F.when(level * F.col("w") <= F.col("most"), level))
    # the first free source has the common level; behind it the level only falls
    common = free.withColumn("level", F.max("level").over(all_rows))
    return common.select(
        "source", "source_size",
        F.least("most", F.coalesce(F.col("level") * F.col("w"), F.col("most"))).alias("target"))


def sampling_key(doc_id: Column, weight: Column, seed: int = 11) -> Column:
    """-ln(u) / weight with u from 52 bits of md5 (the same in any engine)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.ln(u) / weight


def mix_sources(docs: DataFrame, quality: DataFrame | None = None, weights: tuple = WEIGHTS, max_epochs: int = 3,
                buckets: int = 1 << 14, seed: int = 11) -> DataFrame:
    """doc_id, row_hash, source, size, source_size, target, copies (how often
    the mix takes the document), taken (copies * size).

    ``quality`` has doc_id and quality (repeated labels of a document are
    averaged).  One result row per input row."""
    rows = docs.select(
        "doc_id", F.xxhash64(F.col("text")).alias("row_hash"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("size"))
    if quality is not None:
        labels = quality.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("q"))
        rows = rows.join(labels, "doc_id", "left")
        q = F.coalesce(F.col("q"), F.lit(0.4))
        weight = QUALITY_WEIGHT[0] + (QUALITY_WEIGHT[1] - QUALITY_WEIGHT[0]) * q
    else:
        weight = F.lit(1.0)
    key = sampling_key(F.col("doc_id"), weight, seed)
    rows = stage(rows.select("doc_id", "row_hash", "source", "size", key.alias("key")), "mixing-sizes")
    bucket = F.floor((1 - F.exp(-F.col("key"))) * buckets)
    rows = rows.withColumn("bucket", bucket)

    targets = source_targets(rows.select("source", "size"), weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_epochs)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0)
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(run) - F.col("n")).withColumnRenamed("source", "s")
    cut = sums.join(targets, F.col("s").eqNullSafe(F.col("source"))).where(
        (F.col("before") <= F.col("budget")) & (F.col("budget") < F.col("before") + F.col("n")))
    cut = cut.groupBy("source").agg(F.max("bucket").alias("cut"), F.max_by("before", "bucket").alias("before"))
    cut = cut.withColumnRenamed("source", "cs")
    plan = targets.join(cut, F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs").withColumnRenamed("source", "s")
    # one row a source, written: read twice, and broadcast only if its measured size allows
    plan = stage(plan, "mixing-plan")

    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inside = F.col("bucket") == F.col("cut")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "row_hash")
    edge = placed.where(inside).withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("budget")))
    rest = placed.where(~F.coalesce(inside, F.lit(False))).withColumn(
        "extra", F.when(F.col("cut").isNull(), F.col("budget") > 0).otherwise(F.col("bucket") < F.col("cut")))
    cols = ["doc_id", "row_hash", "source", "size", "source_size", "target", "epochs", "extra"]
    copies = (F.col("epochs") + F.col("extra").cast("int")).cast("long")
    return edge.select(*cols).unionByName(rest.select(*cols)).select(
        *cols[:-2], copies.alias("copies"), (F.col("size") * copies).alias("taken"))
