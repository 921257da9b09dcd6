"""Benchmark decontamination: a prefix-filtered set join of item windows.

Words are runs of a-z, 0-9 and characters beyond ASCII, after A-Z is
lower-cased.  A window is ``width`` consecutive words of an item; an item with
fewer words, but not none, is one window.  A document contains a window if
its words have it at some position.

A window has to be contained whole, so its necessary prefix is one shingle:
its rarest, by the corpus's own counts.  The steps:

1. windows of the items and their shingles (a benchmark-sized table);
2. count those shingles over all documents (counted per batch first);
3. keep each window's rarest shingle and its offset in the window;
4. in every document, the positions whose shingle is some window's prefix,
   each with the hashes of the windows that could hold it there;
5. join them on the prefix shingle, apply the length and position bounds, and
   verify the whole window.

Steps 2 and 4 test shingles against a bitmap of ``FILTER_BITS`` bits, the only
thing that is broadcast: 1 MB whatever the benchmark's size.  With more
shingles than bits more positions reach the joins, which stay exact.
Documents' texts are never shuffled.

Edge cases: null or empty text has no words and no hits; a benchmark without
words finds nothing; repeated items count by item_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import shingles as S
from lendframe.llm.common import col, join_rows, keyed, list_array, merge_vectors, slices, stage, texts

WIDTH = 13
SHINGLE = 4
FILTER_BITS = 1 << 23


def _shingle_width(length: int) -> int:
    return SHINGLE if length > SHINGLE else length


def _token(shingle: np.ndarray, length: int) -> np.ndarray:
    """Shingles of windows of different lengths are different tokens."""
    return S.mix(shingle + np.uint64(length))


def _bit(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(41)).astype(np.int64)


def _has(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = _bit(tokens)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, wlen, window, offset, token: every shingle of every window."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = S.Words(S.NON_WORD)
        for batch in slices(batches):
            words, offsets = words_of(texts(batch))
            ids = col(batch, "item_id").to_pylist()
            for i, item in enumerate(ids):
                w = words[offsets[i]: offsets[i + 1]]
                if not len(w):
                    continue
                length = min(width, len(w))
                own = np.array([0, len(w)])
                hashes, ok = S.windows(w, own, length, seed=length)
                tokens, _ = S.windows(w, own, _shingle_width(length))
                tokens = _token(tokens, length)
                n, per = int(ok.sum()), length - _shingle_width(length) + 1
                at = np.arange(n)[:, None] + np.arange(per)[None, :]
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([item] * (n * per)), "wlen": pa.array(np.full(n * per, length, np.int32)),
                    "window": pa.array(np.repeat(hashes[:n], per).view(np.int64)),
                    "offset": pa.array(np.tile(np.arange(per, dtype=np.int32), n)),
                    "token": pa.array(tokens[at].ravel().view(np.int64))})

    kind = dict(benchmark.dtypes)["item_id"]
    return benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(
        expand, f"item_id {kind}, wlen int, window long, offset int, token long")


def token_filter(tokens: DataFrame) -> np.ndarray:
    """The bitmap of a table's tokens."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            at = _bit(batch.column(0).to_numpy().view(np.uint64))
            bits = np.zeros(FILTER_BITS // 8, np.uint8) if bits is None else bits
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if bits is not None:
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], type=pa.binary())], names=["v"])

    found = merge_vectors(tokens.select("token").mapInArrow(mark, "v binary"), "v", "uint8", "or")
    return np.zeros(FILTER_BITS // 8, np.uint8) if found is None else found


def count_tokens(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """token, n: how often the corpus has each token that passes the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = S.Words(S.NON_WORD)
        for batch in slices(batches):
            words, offsets = words_of(texts(batch))
            for length in lengths:
                tokens, ok = S.windows(words, offsets, _shingle_width(length))
                tokens = _token(tokens[ok], length)
                found, n = np.unique(tokens[_has(shared.value, tokens)], return_counts=True)
                if len(found):
                    yield pa.RecordBatch.from_pydict({"token": pa.array(found.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(
        F.sum("n").alias("n"))


def document_hits(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, row_hash, n_words, hits: the positions whose shingle passes the
    bitmap, with the hashes of the windows that begin 0, 1, ... words before
    (null outside the document)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    kind = dict(docs.dtypes)["doc_id"]
    hit = pa.struct([("wlen", pa.int32()), ("token", pa.int64()), ("pos", pa.int32()), ("windows", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = S.Words(S.NON_WORD)
        for batch in slices(batches):
            words, offsets = words_of(texts(batch))
            first = np.repeat(offsets[:-1], np.diff(offsets))
            found = []
            for length in lengths:
                width = _shingle_width(length)
                tokens, ok = S.windows(words, offsets, width)
                tokens = _token(tokens, length)
                at = np.flatnonzero(ok)
                at = at[_has(shared.value, tokens[at])]
                hashes, whole = S.windows(words, offsets, length, seed=length)
                begin = at[:, None] - np.arange(length - width + 1)[None, :]
                inside = begin >= first[at][:, None]
                begin = np.where(inside, begin, 0)
                inside &= whole[begin] if len(words) else inside
                found.append((at, np.full(len(at), length, np.int32), tokens[at], hashes[begin] if len(words) else begin, inside))
            order = np.argsort(np.concatenate([f[0] for f in found]), kind="stable")
            at, wlen, token = (np.concatenate([f[i] for f in found])[order] for i in range(3))
            lists = [h if ok else None for f in found for hs, oks in zip(f[3].view(np.int64).tolist(), f[4].tolist()) for h, ok in zip(hs, oks)]
            sizes = np.concatenate([np.full(len(f[0]), f[3].shape[1] if f[3].ndim == 2 else 0) for f in found])
            windows = list_array(lists, np.concatenate(([0], np.cumsum(sizes))), pa.int64()).take(pa.array(order))
            hits = pa.StructArray.from_arrays(
                [pa.array(wlen), pa.array(token.view(np.int64)), pa.array((at - first[at]).astype(np.int32)), windows], fields=list(hit))
            bounds = np.searchsorted(at, offsets).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": col(batch, "doc_id"), "row_hash": col(batch, "row_hash"), "n_words": pa.array(np.diff(offsets).astype(np.int64)),
                "hits": pa.ListArray.from_arrays(pa.array(bounds), hits)})

    return keyed(docs).mapInArrow(
        scan, f"doc_id {kind}, row_hash long, n_words long, hits array<struct<wlen: int, token: long, pos: int, windows: array<long>>>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, row_hash, n_words, n_hit (words inside a
    contained window), item_ids (array of strings, ascending)."""
    items = stage(item_windows(benchmark, width), "item-windows")
    lengths = sorted(r.wlen for r in items.select("wlen").distinct().collect())  # at most ``width`` values
    if lengths:
        counts = count_tokens(docs, token_filter(items), lengths)
        shingles = items.select("wlen", "window", "offset", "token").distinct().join(counts, "token", "left")
        rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")
        prefix = shingles.groupBy("wlen", "window").agg(F.min(rank).alias("r")).select("wlen", "window", "r.token", "r.offset")
        prefix = stage(prefix, "item-prefixes")
        bits = token_filter(prefix)
    else:
        prefix, bits = items.select("wlen", "window", "token", "offset"), np.zeros(FILTER_BITS // 8, np.uint8)
    rows = stage(document_hits(docs, bits, lengths or [width]), "document-hits")
    at = rows.select("doc_id", "row_hash", "n_words", F.explode("hits").alias("h")).select("doc_id", "row_hash", "n_words", "h.*")
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("wlen") <= F.col("n_words"))
    contained = at.withColumnRenamed("windows", "here").join(prefix, ["token", "wlen"]).where(
        inside & (F.get("here", F.col("offset")) == F.col("window")))
    contained = stage(contained.select("doc_id", "row_hash", "wlen", "window", start.alias("start")).distinct(), "contained-windows")

    spans = contained.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("wlen")).alias("stop")))).alias("spans"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["stop"]))).alias("n"), F.greatest(acc["stop"], x["stop"]).alias("stop"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop")), step)["n"].cast("long")
    hit = spans.select("doc_id", "row_hash", n_hit.alias("n_hit"))
    names = contained.select("doc_id", "row_hash", "window").distinct().join(items.select("window", "item_id").distinct(), "window")
    names = names.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return join_rows(rows.drop("hits"), join_rows(hit, names)).select(
        "doc_id", "row_hash", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)
