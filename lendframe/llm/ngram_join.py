"""Exact Jaccard self-join of documents on word n-grams, by adaptive multi-match
prefixes, and the classes of linked documents.

A document's set is its distinct shingles of ``k`` words, A-Z lower-cased.
All sets are ordered by one global order of shingles, rare first.  Two sets
with Jaccard >= t share at least l shingles in their first
n - ceil(t n) + l ones, for every l >= 1 (n the set's size).  Each document
chooses its own l: the next shingle is added to its prefix, and one more match
asked for, as long as the estimated candidates saved (the posting sizes of the
prefix so far, spread over one more required match) outweigh the posting of
the added shingle.  A pair is verified only if it shares min(l, l') prefix
shingles.

Rarity is an estimate from one counted table of 2^``ORDER_BITS`` cells, 2 MB
whatever the corpus; any total order gives the same result, a better one less
work.

Groups of copies cost no pairs:

1. equal sets become one class, represented by its smallest doc_id;
2. star round: the classes that share a prefix shingle are linked with one
   centre, the class whose prefix is most common (in a group of edited copies
   that is the text nearest to what they share); the edges of these stars are
   verified, and linked classes become one component;
3. only pairs of different components that share a prefix shingle, and pass
   the length and position bounds, are emitted, counted and verified.  The
   t-th shared shingle leaves at most t - 1 shared ones ahead of it, and those
   are among the shingles ahead that any other document has.

Every pair that could link two components is verified, so the classes are
exactly those of the full join.

Edge cases: a text with fewer than ``k`` words is one shingle, its whole
sequence; null, empty or wordless texts have no shingles and link with
nothing; rows of one doc_id are one document; rows with a null doc_id have
their set size and a null class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendframe.llm import shingles as S
from lendframe.llm.common import bitmap_of, col, forget_shuffles, keyed, list_array, marked, merge_vectors, release, slices, stage, staged, texts
from lendframe.llm.components import connected_components, merged_components

ORDER_BITS = 19
MAX_MATCHES = 4
#: Bits of the bitmap that marks the documents whose sets are verified.
MARK_BITS = 1 << 23


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Documents per cell of shingles, over the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, total = S.Words(S.SPACE), None
        for batch in slices(batches):
            values, _ = S.distinct(*S.shingles(*words_of(texts(batch)), k))
            cells = np.bincount(_cell(values), minlength=1 << ORDER_BITS)
            total = cells if total is None else total + cells
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], type=pa.binary())], names=["v"])

    total = merge_vectors(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "v binary"), "v", "float32", "sum", groups=12)
    return np.zeros(1 << ORDER_BITS, np.float32) if total is None else total


def _at_least(n: np.ndarray, t: Fraction) -> np.ndarray:
    """ceil(t n), exactly."""
    return -(-(n * t.numerator) // t.denominator)


def choose_matches(cost: np.ndarray, base: int, n: int) -> int:
    """How many prefix matches a document asks for.  ``cost`` estimates the
    postings of its shingles in order, ``base`` is the prefix length for one."""
    paid = float(cost[:base].sum())
    best, matches = paid, 1
    for extra in range(1, MAX_MATCHES):
        if base + extra > n:
            break
        paid += float(cost[base + extra - 1])
        # scanning the postings, and verifying what reaches the required matches
        total = paid * 0.25 + 0.75 * paid / (extra + 1) ** 2
        if total < best:
            best, matches = total, extra + 1
    return matches


def prefixes(docs: DataFrame, k: int, t: Fraction, counts: np.ndarray) -> DataFrame:
    """doc_id, row_hash, n (set size), set1, set2 (128-bit identity of the
    set), matches, weight (how common the prefix is), prefix (its shingles in
    the global order)."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    load = float(counts.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, noise = S.Words(S.SPACE), 3 * np.sqrt(load) + 1
        for batch in slices(batches):
            values, offsets = S.distinct(*S.shingles(*words_of(texts(batch)), k))
            estimate = shared.value[_cell(values)]
            sizes = np.diff(offsets)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((values, estimate, owner))
            values, estimate = values[order], estimate[order]
            cost = np.maximum(estimate - load - noise, 0)
            base = np.where(sizes > 0, sizes - _at_least(sizes, t) + 1, 0)
            matches = np.ones(len(sizes), np.int32)
            weight = np.zeros(len(sizes))
            identity = np.zeros((2, len(sizes)), np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                identity[0, full] = np.add.reduceat(S.mix(values), offsets[full])
                identity[1, full] = np.add.reduceat(S.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), offsets[full])
            for i in full:
                own = cost[offsets[i]: offsets[i] + base[i] + MAX_MATCHES]
                if own[: base[i]].any():
                    matches[i] = choose_matches(own, int(base[i]), int(sizes[i]))
                    weight[i] = own[: base[i]].sum() / base[i]
            length = np.minimum(base + matches - 1, sizes)
            keep = np.arange(len(values)) - offsets[:-1][owner] < length[owner] if len(values) else np.zeros(0, bool)
            yield pa.RecordBatch.from_pydict({
                "doc_id": col(batch, "doc_id"), "row_hash": col(batch, "row_hash"), "n": pa.array(sizes.astype(np.int32)),
                "set1": pa.array(identity[0].view(np.int64)), "set2": pa.array(identity[1].view(np.int64)),
                "matches": pa.array(matches), "weight": pa.array(weight.astype(np.float32)),
                "prefix": list_array(values[keep].view(np.int64), np.concatenate(([0], np.cumsum(length))))})

    return keyed(docs).mapInArrow(
        run, f"doc_id {kind}, row_hash long, n int, set1 long, set2 long, matches int, weight float, prefix array<long>")


def _spot():
    return F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))


def _postings(rows: DataFrame, chosen: np.ndarray, crowded: np.ndarray | None) -> DataFrame:
    """doc_id, n, matches, weight, pos, token: one row per prefix shingle of
    the documents whose bit is set, and if given, of the shingles whose bit is."""
    kind = dict(rows.dtypes)["doc_id"]
    shared = rows.sparkSession.sparkContext.broadcast((chosen, crowded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_bits, token_bits = shared.value
        for whole in batches:
            whole = whole.filter(pa.array(marked(docs_bits, col(whole, "spot").to_numpy())))
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                lists = col(batch, "prefix")
                token = lists.flatten().to_numpy()
                sizes = pc.list_value_length(lists).to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), sizes)
                pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                if token_bits is not None:
                    keep = marked(token_bits, _token_bit(token))
                    token, owner, pos = token[keep], owner[keep], pos[keep]
                own = {c: col(batch, c).take(pa.array(owner)) for c in ("doc_id", "n", "matches", "weight")}
                yield pa.RecordBatch.from_pydict(own | {"pos": pa.array(pos.astype(np.int32)), "token": pa.array(token)})

    return rows.where("doc_id is not null and n > 0").select("doc_id", "n", "matches", "weight", _spot().alias("spot"), "prefix").mapInArrow(
        run, f"doc_id {kind}, n int, matches int, weight float, pos int, token long")


def _token_bit(token: np.ndarray) -> np.ndarray:
    return (token.view(np.uint64) & np.uint64(MARK_BITS - 1)).astype(np.int64)


def _within(n_a, n_b, pos_a, pos_b, before, t: Fraction):
    """Length bound, and the bound on the overlap by a shared shingle: what is
    left from it on, and at most ``before`` shared ones ahead of it, reach
    t / (1 + t) (n_a + n_b)."""
    num, den = t.numerator, t.denominator
    lengths = F.least(n_a, n_b).cast("long") * den >= F.greatest(n_a, n_b).cast("long") * num
    reach = F.least(n_a - pos_a, n_b - pos_b) + before
    return lengths & (reach.cast("long") * (num + den) >= (n_a + n_b).cast("long") * num)


def _verified(docs: DataFrame, pairs: DataFrame, k: int, t: Fraction) -> DataFrame:
    """The pairs (u, v) of doc_ids whose sets reach the threshold.  Only the
    documents of the pairs are read for their sets: a bitmap of fixed size
    thins the corpus, the joins with the pairs are exact.  Of rows with one
    doc_id and one text the first one's set is joined: copies of a text under
    one id don't multiply the pairs."""
    kind, known = dict(docs.dtypes)["doc_id"], staged()
    pairs = stage(pairs, "pairs")
    ids = stage(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), "pair-ids")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(ids.select(_spot()), MARK_BITS))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, at = S.Words(S.SPACE), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(iter([batch.filter(pa.array(marked(shared.value, col(batch, "spot").to_numpy())))])):
                values, offsets = S.distinct(*S.shingles(*words_of(texts(part)), k))
                yield pa.RecordBatch.from_pydict({
                    "id": col(part, "doc_id"), "row_hash": col(part, "row_hash"), "place": pa.array(np.arange(at, at + part.num_rows)),
                    "s": list_array(values.view(np.int64), offsets)})
                at += part.num_rows

    rows = keyed(docs).where(F.col("doc_id").isNotNull()).select("doc_id", "row_hash", _spot().alias("spot"), "text")
    found = stage(rows.mapInArrow(sets, f"id {kind}, row_hash long, place long, s array<long>"), "pair-sets")
    once = found.groupBy("id", "row_hash").agg(F.min("place").alias("place"))
    at_place = lambda x: once.select(F.col("id").alias(x), F.col("place").alias(f"p{x}"))
    set_of = lambda x: found.select(F.col("place").alias(f"p{x}"), F.col("s").alias(f"s{x}"))
    placed = pairs.join(at_place("u"), "u").join(at_place("v"), "v")
    shared_n = F.size(F.array_intersect("su", "sv"))
    union = F.size("su") + F.size("sv") - shared_n
    ok = (shared_n > 0) & (shared_n.cast("long") * t.denominator >= union.cast("long") * t.numerator)
    links = stage(placed.join(set_of("u"), "pu").join(set_of("v"), "pv").where(ok).select("u", "v").distinct(), "verified")
    release([x for x in staged()[:-1] if x not in known])
    return links


def star_pairs(posts: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (u, v) of doc_ids in different components: of each prefix shingle, the document whose prefix is most
    common with each other one that the length and position bounds let reach the threshold.

    ``posts``: doc_id, n, matches, weight, pos, token, component."""
    centres = posts.groupBy("token").agg(F.max(F.struct("weight", "doc_id", "n", "pos", "matches", "component")).alias("c"), F.count("*").alias("held"))
    c = F.col("c")
    near = _within(F.col("n"), c["n"], F.col("pos"), c["pos"], F.least("matches", c["matches"]) - 1, t)
    found = posts.join(centres.where("held > 1").select("token", "c"), "token").where((F.col("component") != c["component"]) & near)
    return found.select(F.least("doc_id", c["doc_id"]).alias("u"), F.greatest("doc_id", c["doc_id"]).alias("v")).distinct()


def open_pairs(posts: DataFrame, t: Fraction, also: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Pairs (u, v) of doc_ids in different components that share enough of their prefix shingles, by
    length and position bounds, to reach the threshold; no other pair can.

    ``posts``: doc_id, n, matches, pos, token, component, and what ``also`` reads: a further condition that
    every pair which reaches the threshold meets, given the two sides' column endings."""
    # how many shingles ahead of this one any other document has at all
    ahead = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    mixed = posts.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    found = stage(posts.withColumn("ahead", ahead).join(mixed, "token", "left_semi"), "open-postings")
    side = lambda x: found.select("token", *[F.col(c).alias(f"{c}_{x}") for c in found.columns if c != "token"])
    a, b = side("a"), side("b")
    if also is None:
        also = lambda x, y: F.lit(True)
    # the first m shared shingles (m = matches asked for) all pass these bounds in a linked pair
    shared_before = F.least("ahead_a", "ahead_b", F.least("matches_a", "matches_b") - 1)
    bounds = _within(*[F.col(f"{c}_{x}") for c in ("n", "pos") for x in ("a", "b")], shared_before, t)
    pairs = a.join(b, "token").where((F.col("doc_id_a") < F.col("doc_id_b")) & (F.col("component_a") != F.col("component_b")) & bounds & also("_a", "_b"))
    asked = stage(pairs.groupBy(F.col("doc_id_a").alias("u"), F.col("doc_id_b").alias("v")).agg(
        F.count("*").alias("shared"), F.min(F.least("matches_a", "matches_b")).alias("needed")).where("shared >= needed").select("u", "v"), "open-pairs")
    release([x for x in staged()[:-1] if x[1].split("/")[-1].startswith("lendframe-open-postings")])
    return asked


def jaccard_classes(docs: DataFrame, k: int = 4, threshold: Fraction = Fraction(85, 100)) -> DataFrame:
    """One row per input row: doc_id, row_hash, n_shingles, component_id (the
    smallest doc_id reachable by links)."""
    t, known = Fraction(threshold), staged()

    def drop(*names: str) -> None:
        release([x for x in staged() if x not in known and any(f"/lendframe-{n}-" in x[1] for n in names)])

    counts = shingle_counts(docs, k)
    rows = stage(prefixes(docs, k, t, counts), "prefixes")
    slim = stage(rows.select("doc_id", "row_hash", F.col("n").cast("long").alias("n_shingles")), "sizes")

    # 1. one class per set
    named = rows.where("doc_id is not null and n > 0")
    classes = named.groupBy("set1", "set2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    member = stage(named.select("doc_id", "set1", "set2", "n").distinct().join(
        classes.select("set1", "set2", "n", "rep"), ["set1", "set2", "n"]).select("doc_id", "rep"), "members")
    reps = bitmap_of(member.where("doc_id = rep").select(_spot()), MARK_BITS)  # a copy that passes as well does no harm

    # 2. stars around the most common prefix
    centres = _postings(rows, reps, None).groupBy("token").agg(
        F.max(F.struct("weight", "doc_id", "n", "pos", "matches")).alias("c"), F.count("*").alias("held")).where("held > 1").select("token", "c")
    centres = stage(centres, "centres")
    held = bitmap_of(centres.select(F.col("token").bitwiseAND(MARK_BITS - 1)), MARK_BITS)
    crowded = stage(_postings(rows, reps, held).join(centres, "token"), "crowded-postings")
    drop("prefixes", "centres")
    c = F.col("c")
    near = _within(F.col("n"), c["n"], F.col("pos"), c["pos"], F.least("matches", c["matches"]) - 1, t)
    stars = crowded.where((F.col("doc_id") != c["doc_id"]) & near).select(
        F.least("doc_id", c["doc_id"]).alias("u"), F.greatest("doc_id", c["doc_id"]).alias("v")).distinct()
    stars = stage(stars, "stars")
    star_links = _verified(docs, stars, k, t)
    forget_shuffles(docs)
    # a doc_id with several rows of different texts holds their classes together
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("u"), F.count("*").alias("sets")).where("sets > 1")
    same_id = member.join(twice, "doc_id").where("rep <> u").select("u", F.col("rep").alias("v"))
    component = stage(connected_components(star_links.unionByName(same_id)), "star-components")

    # 3. pairs of different components
    forget_shuffles(docs)
    posts = crowded.drop("c", "weight").join(component.withColumnRenamed("vertex", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id"))
    asked = open_pairs(posts, t)
    drop("crowded-postings")
    forget_shuffles(docs)
    cross = _verified(docs, asked.join(stars, ["u", "v"], "left_anti"), k, t)
    drop("open-pairs", "stars")
    forget_shuffles(docs)
    final = stage(merged_components(component, cross), "components")

    home = member.groupBy("doc_id").agg(F.min("rep").alias("vertex")).join(final, "vertex", "left").select(
        "doc_id", F.coalesce("component", "vertex").alias("component"))
    out = slim.join(home, "doc_id", "left")
    result = stage(out.select("doc_id", "row_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "classes")
    release([x for x in staged()[:-1] if x not in known])
    return result
