"""Removal of passages that an earlier document has, by longest-previous-factor
arrays over suffixes that meet in buckets.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a
document with a smaller doc_id.  A suffix array of the whole corpus would sort
every byte; here only suffixes that can have an earlier match are sorted:

1. Every window has an anchor: of its ``GRAM``-byte strings the one with the
   smallest hash (the leftmost of equals).  Equal windows have equal anchors, about one
   byte in 14 begins one.  The run of windows with one anchor, and its bytes, is a snippet.
2. (anchor, text) pairs are partitioned by anchor and streamed in order: what is left
   are the anchors that two different texts have.  Where a task has an anchor from two texts,
   all but one of its pairs are settled before the shuffle, and spread by text: a hot
   anchor sends one pair from each ``HELD_ANCHORS`` anchors.
3. Texts meet their shared anchors again and give out snippets, by 64-bit hash
   and bytes.  Equal snippets combine before the shuffle, with their smallest doc_id:
   a later copy of a snippet goes whole.
4. The distinct snippets of an anchor make a bucket.  The suffixes that begin its
   windows are sorted, neighbours' common prefixes measured, and the previous and
   next smaller document in suffix order give each suffix's longest match in an earlier document.
   Where that reaches ``WINDOW`` the window goes from the snippet's first document.  A bucket of more than ``BUCKET_ROWS``
   distinct snippets is cut into its windows, which meet by their 128-bit hash instead: the
   same result without one task holding the bucket.
5. The ranges meet the text once more and are cut out.

Equal texts (128-bit hash) are one: the smallest doc_id stands for them, every
later copy of 50 bytes or more goes whole, and takes no part in 3 and 4.

Edge cases: null text is empty; matches never cross documents; a text of fewer
than 50 bytes keeps everything; rows of one doc_id aren't earlier than one another
(repeated rows get equal results); a row without doc_id is later than all
that have one, and none of these is earlier than another; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import shingles as S
from lendframe.llm.common import col, forget_shuffles, list_array, release, slices, stage, staged, texts

WINDOW = 50
#: Bytes of an anchor, a multiple of 8.  Longer ones are shared by chance less often, and lie closer together.
GRAM = 24
#: Bytes of the longest snippet: an anchor is that of at most WINDOW - GRAM + 1 windows in a row.
SNIPPET = 2 * WINDOW - GRAM
#: Distinct snippets of one anchor that one suffix array takes.
BUCKET_ROWS = 4096
#: Suffixes sorted at once (whole buckets).
SUFFIXES = 1 << 16
#: Anchors that a task looks through at once for repeats.
HELD_ANCHORS = 1 << 19
_BLOCK = 1 << 19
_POS = np.uint64((1 << 20) - 1)
_LAST = (1 << 63) - 1


def _grams(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from each position."""
    n = len(buf) - GRAM + 1
    h = np.full(n, 0xD1B54A32D192ED03, np.uint64)
    for at in range(0, GRAM, 8):
        h = S.mix(h + np.ndarray((n,), "<u8", buf, at, (1,)))
    return h


def _lowest(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    return np.minimum(key[: len(key) - (width - span)], key[width - span:])


def anchors(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """The anchors of all windows of the texts: owner (text), first and past-the-last
    window (byte positions in the text), hash.  Ordered by text and position."""
    sizes = np.array([len(t) for t in raw], np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(raw), np.uint8)
    found = []
    for at in range(0, max(0, len(buf) - WINDOW + 1), _BLOCK):
        part = np.ascontiguousarray(buf[at: at + _BLOCK + WINDOW - 1])
        h = _grams(part)
        low = _lowest((h & ~_POS) | np.arange(len(h), dtype=np.uint64), WINDOW - GRAM + 1)
        n = len(low)
        owner = np.searchsorted(ends, at + np.arange(n), "right")
        whole = at + np.arange(n) + WINDOW <= ends[owner]
        gram = (low & _POS).astype(np.int64)
        # a new anchor, or the first window of a text; a block's first window may go on with the last block's anchor
        first = whole.copy()
        first[1:] &= (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]) | ~whole[:-1]
        start = np.flatnonzero(first)
        # past the last whole window of the same anchor
        stop = np.searchsorted(np.flatnonzero(first | ~whole), start, "right")
        marks = np.append(np.flatnonzero(first | ~whole), n)
        found.append((owner[start], at + start, at + marks[stop], h[gram[start]], at + gram[start]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    owner, start, stop, value, gram = (np.concatenate(c) for c in zip(*found))
    # one anchor on both sides of a block's end is one
    again = np.zeros(len(owner), bool)
    again[1:] = (gram[1:] == gram[:-1]) & (owner[1:] == owner[:-1]) & (stop[:-1] == start[1:])
    lead = np.flatnonzero(~again)
    if len(lead) < len(owner):
        stop = np.maximum.reduceat(stop, lead)
        owner, start, value = owner[lead], start[lead], value[lead]
    begin = (ends - sizes)[owner]
    return owner, start - begin, stop - begin, value


def window_ranks(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ``WINDOW`` bytes from each start, as big-endian words that sort like the bytes."""
    wide = np.zeros((len(starts), -(-WINDOW // 8) * 8), np.uint8)
    wide[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[starts]
    return wide.view(">u8").astype(np.uint64)


def _smaller_before(doc: np.ndarray, common: np.ndarray, need: int) -> np.ndarray:
    """In suffix order, the common prefix with the nearest earlier entry whose document is
    smaller (0 if none; exact only where it reaches ``need``).  ``common``: with the entry before."""
    prev, least = np.arange(len(doc)) - 1, common.copy()
    open_ = np.flatnonzero((prev >= 0) & (least >= need))
    open_ = open_[doc[prev[open_]] >= doc[open_]]
    while len(open_):
        step = prev[open_]
        least[open_] = np.minimum(least[open_], least[step])
        prev[open_] = prev[step]
        open_ = open_[(prev[open_] >= 0) & (least[open_] >= need)]
        open_ = open_[doc[prev[open_]] >= doc[open_]]
    least[prev < 0] = 0
    return least


def longest_previous(words: np.ndarray, doc: np.ndarray, group: np.ndarray, need: int = WINDOW) -> np.ndarray:
    """For each suffix (its first bytes as ``words``), its longest common prefix with a
    suffix of a smaller document in its group: the longer of those with the previous and
    the next smaller document in suffix order (exact where it reaches ``need``)."""
    n = len(doc)
    order = np.lexsort((*words.T[::-1], group))
    w, d, g = words[order], doc[order], group[order]
    common = np.zeros(n, np.int64)
    if n > 1:
        unlike = np.ascontiguousarray((w[1:] ^ w[:-1]).astype(">u8")).view(np.uint8).reshape(n - 1, -1)[:, :WINDOW] != 0
        common[1:] = np.where(unlike.any(1), unlike.argmax(1), WINDOW)
        common[1:][g[1:] != g[:-1]] = 0
    before = _smaller_before(d, common, need)
    after = _smaller_before(d[::-1], np.concatenate((common[:1] * 0, common[:0:-1])), need)[::-1]
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(before, after)
    return out


def _windows(snippets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all windows of the snippets, the snippet of each, its place there."""
    sizes = np.array([len(s) for s in snippets], np.int64)
    counts = sizes - WINDOW + 1
    row = np.repeat(np.arange(len(snippets)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return window_ranks(np.frombuffer(b"".join(snippets), np.uint8), (np.cumsum(sizes) - sizes)[row] + place), row, place


def _shared_anchors(rows: DataFrame) -> DataFrame:
    """anchor, h: the anchors that texts of different hash h have in common."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            value, h = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((h, value))
            value, h = value[order], h[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (h[1:] != h[:-1])
            value, h = value[new], h[new]
            # two texts here have it: known to be shared; the first goes on as well, to meet those of other tasks
            like = np.concatenate(([False], value[1:] == value[:-1]))
            known = like | np.append(like[1:], False)
            value, h = np.concatenate((value[known], value[~like])), np.concatenate((h[known], h[~like]))
            return pa.RecordBatch.from_pydict({
                "anchor": pa.array(value.view(np.int64)), "h": pa.array(h), "known": pa.array(np.arange(len(value)) < known.sum())})

        for batch in slices(batches):
            owner, _, _, value = anchors(texts(batch))
            held.append((value, col(batch, "h").to_numpy()[owner]))
            n += len(value)
            if n >= HELD_ANCHORS:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last pair read, and whether the pair before has its anchor
        for batch in batches:
            direct = pc.equal(col(batch, "known"), True)
            if pc.any(direct).as_py():
                yield batch.filter(direct).select(["anchor", "h"])
                batch = batch.filter(pc.invert(direct))
            a, h = col(batch, "anchor").to_numpy(), col(batch, "h").to_numpy()
            if not len(a):
                continue
            if held is not None:
                a, h = np.concatenate(([held[0]], a)), np.concatenate(([held[1]], h))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
            a, h = a[new], h[new]
            like = np.zeros(len(a), bool)
            like[1:] = a[1:] == a[:-1]
            if held is not None:
                like[0] = held[2]
            keep = like[:-1] | like[1:]
            if keep.any():
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(a[:-1][keep]), "h": pa.array(h[:-1][keep])})
            held = a[-1], h[-1], like[-1]
        if held is not None and held[2]:
            yield pa.RecordBatch.from_pydict({"anchor": pa.array([held[0]], pa.int64()), "h": pa.array([held[1]], pa.int64())})

    pairs = rows.select("h", "text").mapInArrow(emit, "anchor long, h long, known boolean")
    # what is known already goes by its text: of an anchor that a third of all texts have, a task sees one pair for each that made some
    met = pairs.repartition(F.when(F.col("known"), F.col("h")).otherwise(F.col("anchor"))).sortWithinPartitions("known", "anchor", "h")
    return met.mapInArrow(repeated, "anchor long, h long")


def _snippets(candidates: DataFrame) -> DataFrame:
    """anchor, snippet (hash), size, d, h, start, bytes of every snippet whose anchor is in the row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = texts(batch)
            owner, start, stop, value = anchors(raw)
            lists = col(batch, "anchors")
            wanted = lists.flatten().to_numpy().view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            spot = S.mix(np.repeat(np.arange(len(raw), dtype=np.uint64), sizes)) + wanted
            keep = np.isin(S.mix(owner.astype(np.uint64)) + value, spot)
            owner, start, stop, value = owner[keep], start[keep], stop[keep] + WINDOW - 1, value[keep]
            base = np.cumsum([0] + [len(t) for t in raw])
            bytes_ = [raw[i][s:e] for i, s, e in zip(owner.tolist(), start.tolist(), stop.tolist())]
            at = pa.array(owner)
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(value.view(np.int64)), "snippet": pa.array(_slice_hashes(np.frombuffer(b"".join(raw), np.uint8), base[owner] + start, base[owner] + stop).view(np.int64)),
                "size": pa.array((stop - start).astype(np.int32)), "d": col(batch, "d").take(at), "h": col(batch, "h").take(at),
                "start": pa.array(start), "bytes": pa.array(bytes_, type=pa.binary())})

    return candidates.select("d", "h", "anchors", "text").mapInArrow(
        run, "anchor long, snippet long, size int, d long, h long, start long, bytes binary")


def _slice_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges (each at most ``SNIPPET`` bytes long)."""
    padded = np.concatenate((buf, np.zeros(SNIPPET + 8, np.uint8)))
    words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    h = (stop - start).astype(np.uint64)
    for at in range(0, SNIPPET, 8):
        # the bytes of this word that lie in the range: eight, some, or none
        spare = np.clip(8 - (stop - start - at), 0, 8).astype(np.uint64)
        word = words[np.minimum(start + at, len(words) - 1)]
        word = np.where(spare < 8, (word << (spare % 8 * 8)) >> (spare % 8 * 8), 0)
        h = S.mix(h * np.uint64(0x9E3779B97F4A7C15) + word)
    return h


def _bucket_matches(buckets: DataFrame) -> DataFrame:
    """anchor, snippet, size, starts: windows of the distinct snippets of each anchor (column ``first``: smallest
    document) that a snippet of an earlier document has.  Buckets are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            anchor = table["anchor"].to_numpy()
            words, row, place = _windows(table["bytes"].to_pylist())
            group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
            gone = longest_previous(words, table["first"].to_numpy()[row], group[row]) >= WINDOW
            counts = np.bincount(row[gone], minlength=len(anchor))
            hit = np.flatnonzero(counts)
            take = lambda c: table[c].combine_chunks().take(pa.array(hit))
            return pa.RecordBatch.from_pydict({
                "anchor": take("anchor"), "snippet": take("snippet"), "size": take("size"),
                "starts": list_array(place[gone].astype(np.int32), np.concatenate(([0], np.cumsum(counts[hit]))))})

        def windows(table: pa.Table) -> int:
            return int(table["size"].to_numpy().sum()) - (WINDOW - 1) * table.num_rows

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            if windows(table) < SUFFIXES:
                continue
            anchor = table["anchor"].to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            at = 0
            for head in heads[1:]:
                if windows(table.slice(at, head - at)) >= SUFFIXES:
                    yield solve(table.slice(at, head - at))
                    at = int(head)
            held = table.slice(at).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    rows = buckets.select("anchor", "snippet", "size", "first", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(run, "anchor long, snippet long, size int, starts array<int>")


def _window_matches(buckets: DataFrame) -> DataFrame:
    """As ``_bucket_matches``, for buckets of any size: every window by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="bytes"):
            words, row, place = _windows(col(batch, "bytes").to_pylist())
            keys = []
            for seed in (1, 2):
                key = np.full(len(row), seed, np.uint64)
                for c in words.T:
                    key = S.mix(key * np.uint64(0x9E3779B97F4A7C15) + c)
                keys.append(pa.array(key.view(np.int64)))
            own = {c: col(batch, c).take(pa.array(row)) for c in ("anchor", "snippet", "size", "first")}
            yield pa.RecordBatch.from_pydict({"w1": keys[0], "w2": keys[1], **own, "place": pa.array(place.astype(np.int32))})

    each = buckets.select("anchor", "snippet", "size", "first", "bytes").mapInArrow(
        run, "w1 long, w2 long, anchor long, snippet long, size int, first long, place int")
    each = stage(each, "windows")
    lows = each.groupBy("w1", "w2").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("w1", "w2", "low")
    late = each.join(lows, ["w1", "w2"]).where(F.col("first") > F.col("low"))
    return late.groupBy("anchor", "snippet", "size").agg(F.sort_array(F.collect_list("place")).alias("starts"))


def _cut(marked: DataFrame, kind: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, span_starts, span_ends, kept of rows (doc_id, text, copy, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, copy, lists = texts(batch), col(batch, "copy").to_pylist(), col(batch, "ranges")
            n_removed, starts, ends, kept = [], [], [], []
            for i, text in enumerate(raw):
                if copy[i] and len(text) >= WINDOW:
                    s, e = [0], [len(text)]
                elif lists[i].is_valid and len(lists[i]):
                    own = lists[i].values
                    s, e = _merged(own.field("s").to_numpy(), own.field("e").to_numpy())
                else:
                    s, e = [], []
                starts.append(s)
                ends.append(e)
                n_removed.append(sum(e) - sum(s))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *e], [*s, len(text)])))
            yield pa.RecordBatch.from_pydict({
                "doc_id": col(batch, "doc_id"), "n_bytes": pa.array([len(t) for t in raw], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "span_starts": pa.array(starts, pa.list_(pa.int64())), "span_ends": pa.array(ends, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())})

    return marked.select("doc_id", "text", "copy", "ranges").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept binary")


def _merged(s: np.ndarray, e: np.ndarray) -> tuple[list, list]:
    """Maximal runs of ranges that overlap or touch."""
    order = np.argsort(s, kind="stable")
    s, reach = s[order], np.maximum.accumulate(e[order])
    lead = np.flatnonzero(np.concatenate(([True], s[1:] > reach[:-1])))
    return s[lead].tolist(), reach[np.append(lead[1:], len(s)) - 1].tolist()


def remove_repeats(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, span_starts, span_ends
    (the removed runs, in bytes), kept (the remaining bytes)."""
    kind, known = dict(docs.dtypes)["doc_id"], staged()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), text.alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "h2": F.xxhash64(F.lit(7), "text")})

    # equal texts are one
    ids = rows.where(F.octet_length("text") >= WINDOW).select("d", "h", "h2")
    same = stage(ids.groupBy("h", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last")), "texts")
    copies = ids.join(same.where("first < last").drop("last"), ["h", "h2"]).where(F.col("d") > F.col("first")).select("h", "d").distinct()
    copies = stage(copies, "copies")

    shared = stage(_shared_anchors(rows.where(F.octet_length("text") >= WINDOW)), "shared-anchors")
    forget_shuffles(rows)
    lists = shared.groupBy("h").agg(F.collect_set("anchor").alias("anchors"))
    # texts are streamed past the lists, without a sort
    wanted = same.join(lists, "h").select("h", "h2", F.col("first").alias("d"), "anchors")
    found = stage(_snippets(rows.join(wanted.hint("shuffle_hash"), ["h", "h2", "d"])), "snippets")
    release([x for x in staged() if "shared-anchors" in x[1] and x not in known])
    forget_shuffles(rows)

    key = ["anchor", "snippet", "size"]
    distinct = stage(found.groupBy(*key).agg(
        F.min("d").alias("first"), F.max("d").alias("last"), F.first("bytes").alias("bytes")), "distinct-snippets")
    forget_shuffles(rows)
    spread = distinct.groupBy("anchor").agg(F.count("*").alias("held"), F.min("first").alias("low"), F.max("first").alias("high")).where("held > 1 and low < high")
    buckets = stage(distinct.join(spread.select("anchor", "held"), "anchor"), "buckets")
    few = F.col("held") <= bucket_rows
    matches = _bucket_matches(buckets.where(few))
    if buckets.where(~few).head(1):
        matches = matches.unionByName(_window_matches(buckets.where(~few)))
    matches = stage(matches, "matches")
    # written, so that the join below sees two shuffles and a hot snippet's side is split
    forget_shuffles(rows)
    verdicts = stage(distinct.drop("bytes").join(matches, key, "left").where("first < last or starts is not null").drop("last"), "verdicts")
    release([x for x in staged() if x not in known and any(n in x[1] for n in ("distinct-snippets", "buckets", "matches"))])

    forget_shuffles(rows)
    begin = F.col("start")
    whole = F.array(F.struct(begin.alias("s"), (begin + F.col("size")).alias("e")))
    some = F.transform("starts", lambda x: F.struct((begin + x).alias("s"), (begin + x + WINDOW).alias("e")))
    hits = found.drop("bytes").join(verdicts, key).withColumn("ranges", F.when(F.col("d") > F.col("first"), whole).otherwise(some)).where("ranges is not null")
    # a document's text is known by (doc_id, hash) from here on
    ranges = hits.groupBy("h", "d").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    marks = ranges.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    marks = stage(marks, "marks")
    release([x for x in staged()[:-1] if x not in known])
    forget_shuffles(rows)
    return _cut(rows.drop("h2").join(marks.hint("shuffle_hash"), ["h", "d"], "left"), kind)
