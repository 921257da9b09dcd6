"""Line deduplication over a whole corpus, with DataFrame functions only.

A text is split at newlines.  A line's key is the line without white space
[\\x20\\x09-\\x0D] at both ends and with A-Z lower-cased; keys shorter than
``min_chars`` code points never count.  A key found in at least ``min_docs``
documents keeps its lines only in the largest doc_id that holds it.

Plan: only the keys' 128-bit hashes travel, never text.  They are
range-partitioned on (hash, document, position), so that a line which fills a
third of the corpus is spread over many tasks; each partition is sorted the
same way and streamed once, and what leaves it is the first occurrence of a
key in a document.  Per-key statistics are partially aggregated inside those
partitions.  The result is one run-length encoded bitmap per document that
lost lines (start and end of each dropped run).

Edge cases: null or empty text is one empty line; rows with a null doc_id
keep all their lines and do not count as a document; rows that share a doc_id
are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lendframe.llm.common import SPACES, ascii_lower, join_rows, keyed, release, stage, staged


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def occurrences(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """Every line that counts: doc_id, row_hash, pos, and the key's hash."""
    lines = keyed(docs).where(F.col("doc_id").isNotNull()).select(
        "doc_id", "row_hash", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return keys.where(F.length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "pos", "row_hash")


def repeated_keys(lines: DataFrame, min_docs: int = 3) -> DataFrame:
    """Keys in at least ``min_docs`` documents, with the largest doc_id."""
    order = ["h1", "h2", "doc_id", "pos"]
    ranged = lines.select(*order).repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    stream = Window.partitionBy("h1", "h2", "doc_id").orderBy("pos")
    first = ranged.withColumn("nth", F.row_number().over(stream)).where("nth = 1")
    return first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")).where(
        F.col("n_docs") >= min_docs)


def dropped_runs(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """The compressed bitmaps: doc_id, row_hash, and the dropped lines as runs
    (``starts`` and ``ends``, inclusive, zero-based, ascending).  A document
    that keeps everything has no row."""
    # texts are split once for this; the hashes are read for the range bounds, the stream and the join
    known = staged()
    lines = stage(occurrences(docs, min_chars), "lines")
    # written, so that the join sees two shuffles and a hot line's side is split
    repeated = stage(repeated_keys(lines, min_docs), "repeated-lines")
    lost = lines.join(repeated, ["h1", "h2"]).where(F.col("doc_id") != F.col("last_doc"))
    per_doc = lost.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    p = F.col("p")
    runs = stage(per_doc.select(
        "doc_id", "row_hash",
        F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1)).alias("starts"),
        F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1)).alias("ends")), "dropped-runs")
    release([x for x in staged()[:-1] if x not in known])
    return runs


def kept_lines(lines: Column, starts: Column, ends: Column) -> Column:
    """The lines outside the runs, in order."""
    piece = lambda k: F.slice(
        lines,
        F.when(k == 0, F.lit(1)).otherwise(F.get(ends, k - 1) + 2),
        F.coalesce(F.get(starts, k), F.size(lines)) - F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1) + 1))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), piece))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """doc_id, text (lines kept, joined by newlines), n_lines, n_dropped."""
    rows, runs = keyed(docs), dropped_runs(docs, min_docs, min_chars)
    lines = split_lines(F.col("text"))
    n_dropped = F.coalesce(
        F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a + 1), F.lit(0), lambda acc, x: acc + x), F.lit(0))
    return join_rows(rows, runs, "shuffle_hash").select(
        "doc_id",
        F.when(F.col("starts").isNull(), F.coalesce("text", F.lit(""))).otherwise(
            F.array_join(kept_lines(lines, F.col("starts"), F.col("ends")), "\n")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
