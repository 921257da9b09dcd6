"""MinHash fingerprints of documents, and near duplicates by signature bands.

A document's set is its distinct shingles of five words (fewer words: the
whole sequence; none: empty).  ``PERMUTATIONS`` universal hash functions
a * x + b modulo 2^64 permute the shingles' 64-bit hashes; a fingerprint keeps
16 bits of each minimum, so two fingerprints agree in a share of positions that
estimates the sets' Jaccard similarity (plus 2^-16).  Long texts are permuted in
blocks, so memory does not grow with them.

``near_duplicates`` and ``with_classes`` join the bands of the signatures.
Equal texts are one; documents that agree in a band meet at the band's smallest
doc_id first, and the edges of those stars are verified by the exact Jaccard
similarity of their shingle sets; then the pairs that agree in a band and are
not yet in one component are found among those that share the rare shingles
which the threshold makes necessary (prefixes, length and position bounds; first
around one document for each shingle, then what is still apart), and verified as well.
So all pairs that agree in a band and reach the threshold are in one class, and a family of documents below the threshold to one
another emits no pairs.  Two documents of Jaccard 0.8 agree in one of the 16 bands of 4
with a probability of 0.9998.

Edge cases: null text is empty; an empty set has the fingerprint of all ones,
which is like itself and unlike any other, and links with nothing; equal texts have
equal fingerprints; rows of one doc_id are one document; a row with a null
doc_id has a null class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lendframe.llm import ngram_join as N
from lendframe.llm import shingles as S
from lendframe.llm.common import bitmap_of, col, keyed, list_array, marked, release, slices, stage, staged, texts
from lendframe.llm.components import connected_components, merged_components
from lendframe.llm.ngram_join import MARK_BITS

PERMUTATIONS = 64
BANDS = 16
SHINGLE = 5
THRESHOLD = 0.8
PARITY_BITS = 1 << 10
_BLOCK = 1 << 13


class MinHash:
    def __init__(self, n: int = PERMUTATIONS, seed: int = 5):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.a = draw.integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)
        self.b = draw.integers(0, 1 << 64, n, dtype=np.uint64)
        self.words = S.Words(S.SPACE)

    def minima(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """64-bit minima of each text's shingles, texts x permutations."""
        out = np.full((len(offsets) - 1, len(self.a)), np.iinfo(np.uint64).max, np.uint64)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for at in range(0, len(values), _BLOCK):
            x, who = values[at: at + _BLOCK], owner[at: at + _BLOCK]
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            for i in range(len(self.a)):
                low = np.minimum.reduceat(x * self.a[i] + self.b[i], first)
                out[who[first], i] = np.minimum(out[who[first], i], low)
        return out

    def __call__(self, raw: list[bytes]) -> list[bytes]:
        """Fingerprints: 16 bits of each minimum, big-endian."""
        words, offsets = self.words(raw)
        values, bounds = S.shingles(words, offsets, SHINGLE)
        low = self.minima(values, bounds)
        prints = (S.mix(low) >> np.uint64(48)).astype(">u2")
        prints[np.diff(bounds) == 0] = 0xFFFF
        return [p.tobytes() for p in prints]


def likeness(a: Column, b: Column) -> Column:
    """Share of equal positions of two binary fingerprints."""
    same = F.aggregate(
        F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1)), F.lit(0),
        lambda n, i: n + (F.substring(a, 2 * i + 1, 2) == F.substring(b, 2 * i + 1, 2)).cast("int"))
    return same / F.lit(float(PERMUTATIONS))


def _like(a: bytes, b: bytes) -> float:
    return float(np.mean(np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")))


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many code points
    (or all) of the following document."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, fingerprint (binary) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash()
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({
                "doc_id": col(batch, "doc_id"), "row_hash": col(batch, "row_hash"),
                "fingerprint": pa.array(minhash(texts(batch)), type=pa.binary())})

    return keyed(docs).mapInArrow(run, f"doc_id {kind}, row_hash long, fingerprint binary")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and that of its text edited with the next
    document's beginning (descending doc_id, after the last the first).

    The rows are range-partitioned once, by descending doc_id, and each sorted
    partition is read once with the row that follows; a partition's last row
    meets the next partition's first row afterwards (one row per partition)."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = (f"doc_id {kind}, row_hash long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
              "near_edited double, near_next double, part int, place string, text string")

    def rows(ids, hashes, own, nxt, minhash, prints, next_prints) -> dict:
        edited = [edit(t, f).encode() for t, f in zip(own, nxt)]
        edited_prints = minhash(edited)
        return {
            "doc_id": ids, "row_hash": hashes, "n_chars": [len(t) for t in own],
            "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
            "fingerprint": prints, "edited_fingerprint": edited_prints,
            "near_edited": [_like(a, b) for a, b in zip(prints, edited_prints)],
            "near_next": [_like(a, b) for a, b in zip(prints, next_prints)]}

    arrow = pa.schema([
        ("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("row_hash", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()),
        ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("place", pa.string()), ("text", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        minhash = MinHash()
        held = None  # the last row read: doc_id, row_hash, text, fingerprint

        def edge(row, place):
            return pa.RecordBatch.from_pylist([{"doc_id": row[0], "row_hash": row[1], "text": row[2], "fingerprint": row[3], "part": part, "place": place}], schema=arrow)

        for batch in slices(batches):
            own = [x or "" for x in col(batch, "text").to_pylist()]
            raw = [t.encode() for t in own]
            block = list(zip(col(batch, "doc_id").to_pylist(), col(batch, "row_hash").to_pylist(), own, minhash(raw)))
            if held is None:
                yield edge(block[0], "first")
            else:
                block.insert(0, held)
            held = block[-1]
            if len(block) > 1:
                ids, hashes, own, prints = map(list, zip(*block))
                found = rows(ids[:-1], hashes[:-1], own[:-1], own[1:], minhash, prints[:-1], prints[1:])
                yield pa.RecordBatch.from_pydict(found | {"part": [part] * (len(ids) - 1), "place": ["inside"] * (len(ids) - 1), "text": [None] * (len(ids) - 1)}, schema=arrow)
        if held is not None:
            yield edge(held, "last")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash()
        for batch in slices(batches, column="text"):
            b = {n: col(batch, n).to_pylist() for n in ("doc_id", "row_hash", "text", "fingerprint", "next_text", "next_fingerprint")}
            found = rows(b["doc_id"], b["row_hash"], b["text"], b["next_text"], minhash, b["fingerprint"], b["next_fingerprint"])
            yield pa.RecordBatch.from_pydict(found, schema=pa.schema([arrow.field(n) for n in found]))

    order = [F.col("doc_id").desc_nulls_last(), F.col("row_hash")]
    sorted_rows = keyed(docs).repartitionByRange(*order).sortWithinPartitions(*order)
    done = stage(sorted_rows.mapInArrow(stream, schema), "fingerprints")
    columns = done.columns[:8]
    inside = done.where("place = 'inside'").select(*columns)
    # one small row per partition: which partition follows
    by_part = Window.orderBy("part")
    parts = done.where("place = 'first'").select("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(Window.partitionBy())).alias("next_part"))
    last = done.where("place = 'last'").select("part", "doc_id", "row_hash", "text", "fingerprint")
    first = done.where("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = last.join(follows, "part").join(first, "next_part").select("doc_id", "row_hash", "text", "fingerprint", "next_text", "next_fingerprint")
    closed = ends.mapInArrow(close, ", ".join(schema.split(", ")[:8]))
    return inside.unionByName(closed)


def _buckets(prints: DataFrame) -> DataFrame:
    """doc_id, bucket: one row per document and band, and one for the whole
    fingerprint (equal sets meet whatever else is in their bands)."""
    width = 2 * PERMUTATIONS // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("fingerprint", i * width + 1, width)))
    return prints.select("doc_id", F.explode(F.concat(bands, F.array(F.xxhash64(F.lit(BANDS), "fingerprint")))).alias("bucket")).distinct()


def _parity(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each set, which of ``PARITY_BITS`` cells hold an odd number of its
    members.  Two sets differ in at least as many members as cells."""
    n = len(offsets) - 1
    cell = np.repeat(np.arange(n), np.diff(offsets)) * PARITY_BITS + (S.mix(values) >> np.uint64(32)).astype(np.int64) % PARITY_BITS
    odd = np.bincount(cell, minlength=n * PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, PARITY_BITS), axis=1, bitorder="little").reshape(-1).view(np.int64)


def _may_reach(threshold: float, x: str, y: str) -> Column:
    """Whether two sets, by their sizes ``n`` and parities ``p`` (columns with endings x and y), differ in few
    enough members: Jaccard = (total - differing) / (total + differing)."""
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    cells = F.aggregate(F.zip_with(f"p{x}", f"p{y}", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, c: total + c)
    return F.greatest(cells, F.abs(n - m)) * (1 + threshold) <= (n + m) * (1 - threshold + 1e-9)


def _parities(rows: DataFrame) -> DataFrame:
    """doc_id, p (see ``_parity``) of every text."""
    kind, longs = dict(rows.dtypes)["doc_id"], PARITY_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = S.Words(S.SPACE)
        for batch in slices(batches):
            values, offsets = S.distinct(*S.shingles(*words_of(texts(batch)), SHINGLE))
            yield pa.RecordBatch.from_pydict({"doc_id": col(batch, "doc_id"), "p": list_array(_parity(values, offsets), np.arange(len(offsets)) * longs)})

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p array<long>").dropDuplicates(["doc_id", "p"])


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs u, v of doc_ids that reach the threshold, with their jaccard.
    Pairs that differ in too many members by their sizes or parities go before
    the sets are joined."""
    kind, known = dict(docs.dtypes)["doc_id"], staged()
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    pairs = stage(pairs, "band-pairs")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select(spot), MARK_BITS))
    longs = PARITY_BITS // 64

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = S.Words(S.SPACE)
        for batch in batches:
            for part in slices(iter([batch.filter(pa.array(marked(shared.value, col(batch, "spot").to_numpy())))])):
                values, offsets = S.distinct(*S.shingles(*words_of(texts(part)), SHINGLE))
                yield pa.RecordBatch.from_pydict({
                    "id": col(part, "doc_id"), "n": pa.array(np.diff(offsets).astype(np.int32)),
                    "p": list_array(_parity(values, offsets), np.arange(len(offsets)) * longs), "s": list_array(values.view(np.int64), offsets)})

    rows = keyed(docs).where(F.col("doc_id").isNotNull()).select("doc_id", spot.alias("spot"), "text")
    found = stage(rows.mapInArrow(sets, f"id {kind}, n int, p array<long>, s array<long>"), "band-sets")
    side = lambda x, c: found.select(F.col("id").alias(x), *[F.col(k).alias(f"{k}{x}") for k in c])
    cells = F.aggregate(F.zip_with("pu", "pv", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    # Jaccard = (total - differing) / (total + differing)
    differing, total = F.greatest(cells, F.abs(F.col("nu") - F.col("nv"))), (F.col("nu") + F.col("nv"))
    near = pairs.join(side("u", "np"), "u").join(side("v", "np"), "v").where(differing * (1 + threshold) <= total * (1 - threshold + 1e-9))
    near = stage(near.select("u", "v").distinct(), "near-pairs")
    shared_n = F.size(F.array_intersect("su", "sv"))
    union = F.size("su") + F.size("sv") - shared_n
    likely = near.join(side("u", "s"), "u").join(side("v", "s"), "v").select("u", "v", F.try_divide(shared_n.cast("double"), union).alias("jaccard"))
    links = stage(likely.where(F.col("jaccard") >= threshold).groupBy("u", "v").agg(F.max("jaccard").alias("jaccard")), "band-links")
    release([x for x in staged()[:-1] if x not in known])
    return links


def _marked_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the rows whose doc_id is in ``ids`` (one text of each doc_id), and a few others
    that a bitmap of fixed size lets through."""
    kind = dict(docs.dtypes)["doc_id"]
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select(spot), MARK_BITS))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.filter(pa.array(marked(shared.value, col(batch, "spot").to_numpy())))
            yield keep.select(["doc_id", "text"])

    rows = keyed(docs).where(F.col("doc_id").isNotNull()).select("doc_id", spot.alias("spot"), "text")
    return rows.mapInArrow(pick, f"doc_id {kind}, text string")


def _linked(docs: DataFrame, prints: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links u, v, jaccard (u < v) and the components they make: vertex, component."""
    known = staged()
    none = F.lit(b"\xff" * 2 * PERMUTATIONS)
    named = prints.where(F.col("doc_id").isNotNull() & (F.col("fingerprint") != none)).select("doc_id", "row_hash", "fingerprint")

    # 1. equal texts: the smallest doc_id stands for them
    first = stage(named.groupBy("row_hash", "fingerprint").agg(F.min("doc_id").alias("u")), "band-texts")
    copies = named.join(first, ["row_hash", "fingerprint"]).where("doc_id <> u").select("u", F.col("doc_id").alias("v")).distinct()
    copies = stage(copies.withColumn("jaccard", F.lit(1.0)), "band-copies")

    # 2. stars around each bucket's smallest doc_id
    rows = _buckets(first.select(F.col("u").alias("doc_id"), "fingerprint"))
    lows = rows.groupBy("bucket").agg(F.min("doc_id").alias("u"), F.count("*").alias("n")).where("n > 1")
    crowded = stage(rows.join(lows, "bucket"), "band-crowded")
    stars = stage(crowded.where("doc_id <> u").select("u", F.col("doc_id").alias("v")).distinct(), "band-stars")
    star_links = _verified(docs, stars, threshold)
    component = stage(connected_components(copies.select("u", "v").unionByName(star_links.select("u", "v"))), "band-star-components")

    # 3. pairs that share a bucket, of different components: those that also share the
    # prefix shingles that the threshold makes necessary (no pair of a bucket is emitted before)
    placed = crowded.select("bucket", "doc_id").join(component.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    placed = stage(placed, "band-placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    open_docs = placed.join(mixed, "bucket", "left_semi").groupBy("doc_id", "component").agg(F.collect_set("bucket").alias("buckets"))
    open_docs = stage(open_docs, "band-open")
    t = Fraction(str(threshold))
    rows = stage(_marked_rows(docs, open_docs.select("doc_id")), "band-open-rows")
    posts = stage(N.prefixes(rows, SHINGLE, t, N.shingle_counts(rows, SHINGLE)).where("n > 0").select(
        "doc_id", "n", "matches", "weight", F.posexplode("prefix").alias("pos", "token")), "band-posts")
    placed_posts = lambda c: posts.join(c.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")).join(open_docs.select("doc_id"), "doc_id", "left_semi")
    # a second star round, around the most common prefix that holds each shingle
    token_stars = stage(N.star_pairs(placed_posts(component), t), "band-token-stars")
    token_links = _verified(rows, token_stars.join(stars, ["u", "v"], "left_anti"), threshold)
    component = stage(merged_components(component, token_links.select("u", "v")), "band-second-components")
    parted = placed_posts(component).drop("weight").join(_parities(rows), "doc_id")
    asked = N.open_pairs(parted, t, lambda x, y: _may_reach(threshold, x, y)).join(token_stars, ["u", "v"], "left_anti")
    side = lambda x: open_docs.select(F.col("doc_id").alias(x), F.col("buckets").alias(f"buckets_{x}"))
    agree = asked.join(side("u"), "u").join(side("v"), "v").where(F.arrays_overlap("buckets_u", "buckets_v")).select("u", "v")
    cross = _verified(rows, agree.join(stars, ["u", "v"], "left_anti"), threshold).unionByName(token_links)
    component = merged_components(component, cross.select("u", "v"))

    links = stage(copies.unionByName(star_links).unionByName(cross).groupBy("u", "v").agg(F.max("jaccard").alias("jaccard")), "band-all-links")
    component = stage(component, "band-components")
    release([x for x in staged()[:-2] if x not in known])
    return links, component


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified near duplicates a, b, jaccard: links that reach the threshold
    and hold the classes together (not every pair inside a class)."""
    links, _ = _linked(docs, fingerprints(docs), threshold)
    return links.select(F.col("u").alias("a"), F.col("v").alias("b"), "jaccard")


def with_classes(docs: DataFrame, prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``prints`` (fingerprints of the rows of ``docs``) with ``class_id``: the
    smallest doc_id reachable by links between documents that agree in a band
    and reach the threshold; null without a doc_id."""
    _, component = _linked(docs, prints, threshold)
    found = component.select(F.col("vertex").alias("doc_id"), F.col("component").alias("class_id"))
    return prints.join(found, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
