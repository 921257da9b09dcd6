"""Ranked lexical search of a stated set of items over all documents, by an
Aho-Corasick scan of the texts.

There is no document index.  All terms of the items make one automaton; every
pattern is a term between two guard bytes, and a text is scanned with each run
of separators' bytes replaced by guards, so a match is always a whole term and
neighbouring terms share their guard.  The scan counts the terms' frequencies
(tf) straight from the text; the automaton's outputs map a term to the items
that hold it.

1. statistics scan: documents with a term (N), all terms (L), and of every item
   term the documents that hold it (df): vectors of the automaton's size, added
   up in two levels;
2. scoring scan: tf again, integer scores, and each task keeps an item's best
   ``k`` documents only;
3. the tasks' best meet in two window steps, so that no task sees one item's
   rows of all tasks.

A term is a maximal match of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z
lower-cased.  The score of a document sums w * ((10^9 tf) div (1000 tf + 20 m))
over the item's distinct terms, with w = floor(1000 ln((2N + 2) / (2df + 1)))
and m = 50 + (50 n N) div L for a document of n terms.

Memory: items are taken in blocks of about ``BLOCK_BYTES`` of term text (items are
dealt to blocks by hash; one item is never cut), and each block is one automaton, broadcast, and
one pair of scans.  Score tables are cut to ``CELLS`` cells.

Edge cases: null or termless texts score nothing and don't count for N; items
without terms have no rows; rows of one item_id are one item (also of a null one); repeated
documents are ranked one by one; equal scores go by ascending doc_id, null
last; an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendframe.llm.common import ascii_lower, col, merge_vectors, slices, stage, texts

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 50
#: Term text of the items in one automaton.
BLOCK_BYTES = 1 << 20
#: Cells of one score table (documents x items) in a task.
CELLS = 1 << 18
#: Tasks' best documents of an item meet in so many groups before the last step.
GROUPS = 64
_KEPT = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: Every separator byte becomes a guard, A-Z become lower case, all else stays.
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in set(_KEPT) else 0x20 for b in range(256))


def guarded(raw: bytes) -> bytes:
    """A text with a guard around every term."""
    return b" " + raw.translate(_TABLE) + b" "


class Terms:
    """The terms of a block of items: numbered, with the items of each."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        """``items``: (item number, distinct terms)."""
        self.terms = sorted({t for _, ts in items for t in ts})
        number = {t: i for i, t in enumerate(self.terms)}
        self.n_items = len(items)
        pairs = sorted((number[t], i) for i, ts in items for t in ts)
        self.item_of = np.array([i for _, i in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.terms) + 1))

    def automaton(self):
        import ahocorasick
        found = ahocorasick.Automaton()
        for i, term in enumerate(self.terms):
            found.add_word(guarded(term.encode()).decode("latin-1"), i)
        found.make_automaton()
        return found


def term_counts(automaton, raw: list[bytes], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text (all of them, with repeats), and of the automaton's
    terms: document, term, tf in three arrays."""
    total = np.zeros(len(raw), np.int64)
    docs, terms, tfs = [], [], []
    for i, text in enumerate(raw):
        line = guarded(text)
        total[i] = len(line.split())
        # one character for each byte
        hit = np.fromiter((t for _, t in automaton.iter(line.decode("latin-1"))), np.int64)
        if len(hit):
            found, tf = np.unique(hit, return_counts=True)
            docs.append(np.full(len(found), i))
            terms.append(found)
            tfs.append(tf)
    if not docs:
        none = np.zeros(0, np.int64)
        return total, none, none, none
    return total, np.concatenate(docs), np.concatenate(terms), np.concatenate(tfs)


class Best:
    """The best ``k`` of each item so far: score descending, doc_id ascending, null last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.zeros(n_items, np.int64)
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = (score > 0) & (score >= self.least[item])
        self.rows.append((item[keep], score[keep], doc[keep], null[keep]))
        self.held += int(keep.sum())
        if self.held > 4 * self.k * len(self.least) + 100_000:
            self.prune()

    def prune(self) -> tuple:
        item, score, doc, null = (np.concatenate(c) for c in zip(*self.rows)) if self.rows else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((doc, null, -score, item))
        item, score, doc, null = item[order], score[order], doc[order], null[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        full = nth == self.k - 1
        self.least[item[full]] = score[full]
        keep = nth < self.k
        self.rows = [(item[keep], score[keep], doc[keep], null[keep])]
        self.held = int(keep.sum())
        return self.rows[0]


def _statistics(docs: DataFrame, terms: Terms) -> tuple[int, int, np.ndarray]:
    """N, L and every term's df."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, automaton = shared.value, None
        sums = np.zeros(len(own.terms) + 2, np.int64)
        for batch in slices(batches):
            automaton = automaton or own.automaton()
            total, _, term, _ = term_counts(automaton, texts(batch), len(own.terms))
            sums[:-2] += np.bincount(term, minlength=len(own.terms))
            sums[-2:] += np.count_nonzero(total), total.sum()
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], type=pa.binary())], names=["v"])

    sums = merge_vectors(docs.select("text").mapInArrow(run, "v binary"), "v", "int64", "sum")
    shared.unpersist()
    return (0, 0, np.zeros(len(terms.terms), np.int64)) if sums is None else (int(sums[-2]), int(sums[-1]), sums[:-2])


def _block_scores(docs: DataFrame, terms: Terms, k: int) -> DataFrame | None:
    """item (number), score, doc_id: each task's best."""
    n_docs, n_all, df = _statistics(docs, terms)
    if not n_docs:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((terms, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, w), automaton = shared.value, None
        best = Best(own.n_items, k)
        step = max(1, CELLS // own.n_items)
        for whole in slices(batches):
            automaton = automaton or own.automaton()
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                total, row, term, tf = term_counts(automaton, texts(batch), len(own.terms))
                m = 50 + (50 * total * n_docs) // n_all
                part = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                # each part goes to all items that hold its term
                items = own.first[term + 1] - own.first[term]
                source = np.repeat(np.arange(len(term)), items)
                item = own.item_of[np.arange(len(source)) - np.repeat(np.cumsum(items) - items, items) + np.repeat(own.first[term], items)]
                table = np.zeros(batch.num_rows * own.n_items, np.int64)
                np.add.at(table, row[source] * own.n_items + item, part[source])
                hit = np.flatnonzero(table)
                ids = col(batch, "doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                doc = ids.fill_null(0).to_numpy()
                r = hit // own.n_items
                best.add(hit % own.n_items, table[hit], doc[r], null[r])
        item, score, doc, null = best.prune()
        if len(item):
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(item, pa.int64()), "score": pa.array(score, pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=null.astype(bool))})

    return docs.mapInArrow(run, "item long, score long, doc_id long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (score above 0) of
    each item.  ``docs`` has an integer doc_id and text, ``items`` item_id and text."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = items.select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text").cast("string")), F.lit(TERM), 0)).alias("term"))
    found = stage(found.distinct(), "item-terms")
    total = found.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(total) // block_bytes))
    found = found.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    kind = items.schema["item_id"].dataType
    parts = []
    for block in range(n_blocks):
        held = found.where(F.col("block") == block).groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        held.sort(key=lambda r: (r.item_id is None, r.item_id))
        if not held:
            continue
        scores = _block_scores(rows, Terms([(i, r.terms) for i, r in enumerate(held)]), k)
        if scores is None:
            continue
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(held)], schema=_names_schema(kind))
        parts.append(stage(scores, "task-best").join(F.broadcast(names), "item"))
    if not parts:
        return spark.createDataFrame([], _result_schema(kind))
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    best = best.withColumn("slot", F.pmod(F.xxhash64("doc_id", "score"), F.lit(GROUPS)))
    for keys in (["item_id", "slot"], ["item_id"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def _names_schema(kind):
    from pyspark.sql import types as T
    return T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)])


def _result_schema(kind):
    from pyspark.sql import types as T
    return T.StructType([
        T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
