"""Scratch tables, row keys and other helpers the operators share."""

from __future__ import annotations

import atexit
import gc
import threading
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lendframe.session import ensure_checkpoint_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: [\x20\x09-\x0D] as plain characters.
SPACES = " \t\n\x0b\x0c\r"

_SCRATCH: list[tuple[SparkSession, str]] = []
_OWNER: dict[str, int] = {}  # path -> the thread that staged it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and
    read it back: cuts the lineage, is columnar (readers prune), and survives
    lost executors.  ``release`` deletes what was staged."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/lendframe-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    keep_until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> list:
    """What this thread has staged now, oldest first."""
    return [x for x in _SCRATCH if _OWNER.get(x[1]) == threading.get_ident()]


def release(some: list | None = None) -> None:
    """Delete staged tables (all, or some).  Results that still read them must
    have been written before."""
    for item in list(_SCRATCH if some is None else some):
        if item in _SCRATCH:
            _SCRATCH.remove(item)
        spark, path = item
        _OWNER.pop(path, None)
        sc = spark.sparkContext
        if sc._jsc is None or sc._jsc.sc().isStopped():
            continue
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def forget_shuffles(df: DataFrame) -> None:
    """Have the driver collect the plans of steps that are done, so that Spark's cleaner
    deletes their shuffle files now and not at its next turn (every 30 minutes), and its heap
    shrinks to what is still in use.  Plans are let go by Python first, and reach the JVM's
    collector a moment later."""
    gc.collect()
    for _ in range(2):
        time.sleep(0.3)
        df.sparkSession.sparkContext._jvm.System.gc()


def keep_until_exit(spark: SparkSession, path: str) -> None:
    _SCRATCH.append((spark, path))
    _OWNER[path] = threading.get_ident()


@atexit.register
def _release_at_exit() -> None:
    try:
        release()
    except Exception:  # the JVM is gone already; nothing can be deleted through it
        _SCRATCH.clear()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, text: what the operators read of a documents table."""
    return docs.select(
        F.col("doc_id"), F.xxhash64(F.col("text")).alias("row_hash"), F.col("text").cast("string").alias("text"))


def join_rows(left: DataFrame, right: DataFrame, hint: str | None = None) -> DataFrame:
    """Left join on the row key, null-safe; ``right`` has a row key once."""
    r = right.withColumnsRenamed({"doc_id": "_doc_id", "row_hash": "_row_hash"})
    r = r.hint(hint) if hint else r
    on = left["doc_id"].eqNullSafe(r["_doc_id"]) & (left["row_hash"] == r["_row_hash"])
    return left.join(r, on, "left").drop("_doc_id", "_row_hash")


def _packed(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``, out of the way of other names), doc_id, h (hash of the text)."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.xxhash64("text").alias("h"))


def _keys(keys: DataFrame, *more: str) -> DataFrame:
    return keys.select(F.col("doc_id").alias("key_id"), F.col("row_hash").alias("key_hash"), *more)


def keep_texts(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row of each text whose hash is in ``hashes`` (column ``row_hash``, once each), and every
    row whose text has no word.  Of equal texts the row whose doc_id hashes lowest stays."""
    rows = _packed(docs).withColumn("worded", F.coalesce(F.col("row")["text"].rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    rows = rows.withColumn("k", F.xxhash64("doc_id"))
    wanted = hashes.select(F.col("row_hash").alias("h"))
    one = rows.where("worded").groupBy("h").agg(F.min("k").alias("k")).join(wanted, "h")
    # a copy is as rare as its (text, doc_id): equal texts do not meet in one task
    once = rows.where("worded").join(one, ["h", "k"]).dropDuplicates(["h", "k"])
    return once.select("row.*").unionByName(rows.where("not worded").select("row.*"))


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key (doc_id, row_hash) is not in ``keys`` (null-safe)."""
    gone = (F.col("doc_id").eqNullSafe(F.col("key_id"))) & (F.col("h") == F.col("key_hash"))
    return _packed(docs).join(_keys(keys), gone, "left_anti").select("row.*")


def repeat_rows(docs: DataFrame, times: DataFrame) -> DataFrame:
    """Each row as often as ``times`` (doc_id, row_hash, copies) says; rows
    without an entry go."""
    same = (F.col("doc_id").eqNullSafe(F.col("key_id"))) & (F.col("h") == F.col("key_hash"))
    found = _packed(docs).join(_keys(times, "copies"), same)
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does the same in text without other
    upper-case letters (or characters that the regex engine doesn't know yet),
    and is much faster than ``translate``."""
    return F.when(c.rlike(r"[[\p{IsUppercase}\p{Lt}\p{Cn}]&&[^\x00-\x7F]]"), F.translate(c, ASCII_UPPER, ASCII_LOWER)).otherwise(
        F.lower(c))


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from: crc32(doc_id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the columns alone (52 bits)."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 12)
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 18, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds at most ``limit`` bytes of
    text (and ``rows`` rows), or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy()
        ends = np.cumsum(sizes, dtype=np.int64)
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            stop = min(stop, start + rows) if rows else stop
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null as empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def col(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def list_array(values: np.ndarray, offsets: np.ndarray, kind=None) -> pa.Array:
    """Arrow lists from one flat array and its n + 1 offsets."""
    flat = pa.array(values) if kind is None else pa.array(values, type=kind)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)


def merge_vectors(parts: DataFrame, column: str, dtype: str, how: str, groups: int = 12) -> np.ndarray | None:
    """Sum or OR equally long binary vectors (one row per partition) in two
    levels, so that a task sees a ``groups``-th of them, another one ``groups``,
    and the driver one.  The result has the vectors' fixed size."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                v = np.frombuffer(raw, dtype=dtype)
                total = v.copy() if total is None else (np.add if how == "sum" else np.bitwise_or)(total, v, out=total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["v"])

    # dealt round-robin; the driver gets no vector but the result
    groups_of = parts.select(F.col(column).alias("v")).repartition(groups).mapInArrow(fold, "v binary")
    found = groups_of.repartition(1).mapInArrow(fold, "v binary").collect()
    return np.frombuffer(found[0].v, dtype=dtype).copy() if found else None


def bitmap_of(cells: DataFrame, n_bits: int) -> np.ndarray:
    """A bitmap of fixed size with the bits of the first column (0 to
    ``n_bits`` - 1) set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            bits = np.zeros(n_bits, bool) if bits is None else bits
            bits[batch.column(0).to_numpy()] = True
        if bits is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], type=pa.binary())], names=["v"])

    found = merge_vectors(cells.mapInArrow(mark, "v binary"), "v", "uint8", "or", groups=12)
    return np.zeros(n_bits // 8, np.uint8) if found is None else found


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
