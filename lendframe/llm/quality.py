"""Text quality by a generalised additive model with pairwise interactions.

Every text becomes a few features of its own characters, words and lines (no
labels, language, source or id).  Features are cut into quantile bins; cyclic
boosting visits one feature after the other, fits a shallow tree on its bins'
histogram to the current residuals and adds a small step to the feature's
lookup table.  Then the pairs of features whose joint histogram explains most
of what is left get two-way tables in the same manner.  A score is the sum of
table entries: bins are looked up for whole batches at once.

Fitting takes a bounded sample of labelled rows (``MAX_TRAIN_ROWS``, by a hash
of doc_id); features are computed for every whole text.

Edge cases: null or empty text has features of 0 and gets the score its bins
give; without any labelled row every score is 0.5; repeated labels of a
document are averaged (above one half counts as 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm import shingles as S
from lendframe.llm.common import col, held_out, slices, stage, texts

FEATURES = (
    "log_words", "word_length", "word_length_spread", "short_words", "long_words", "upper", "digits", "marks", "odd_marks", "non_ascii",
    "stops", "commas", "marks_at_word_end", "distinct_words", "repeats_next", "top_word", "distinct_pairs", "line_length", "distinct_lines",
    "short_lines", "bars", "capital_words", "upper_words", "at_signs")
#: Bound on the labelled rows the tables are fitted on.
MAX_TRAIN_ROWS = 20000
_MARKS = np.zeros(256, bool)
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_PROSE = np.zeros(256, bool)
_PROSE[[ord(c) for c in ".,;:'\"()-!?"]] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def text_features(raw: list[bytes], words_of: S.Words) -> np.ndarray:
    """Texts x FEATURES, each from the whole text."""
    n = len(raw)
    joined = b"\n".join(raw) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in raw])))
    size = np.maximum(np.diff(bounds) - 1, 1).astype(np.float64)
    upper = (buf >= 65) & (buf <= 90)
    marks = _MARKS[buf]
    per = lambda flags: _sums(flags, bounds)

    space = S.SPACE[buf]
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    words, offsets = words_of(raw)
    counts = np.diff(offsets).astype(np.float64)
    some = np.maximum(counts, 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    length = (ends - starts + 1).astype(np.float64)
    by_text = lambda x: np.bincount(owner, weights=x, minlength=n)
    mean = by_text(length) / some
    same_text = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    next_same = np.zeros(len(words))
    if len(words):
        next_same[:-1] = (words[1:] == words[:-1]) & same_text

    order = np.lexsort((words, owner))
    w, o = words[order], owner[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(w)))
    most = np.zeros(n)
    np.maximum.at(most, o[new], runs)
    pair_values, pair_bounds = S.shingles(words, offsets, 2)
    pairs, pair_kinds = np.diff(pair_bounds), np.diff(S.distinct(pair_values, pair_bounds)[1])

    line_end = buf == 10
    lines = per(line_end)
    breaks = np.flatnonzero(line_end)
    line_len = np.diff(np.concatenate(([-1], breaks))) - 1
    line_owner = np.repeat(np.arange(n), lines.astype(np.int64))
    kinds = np.array([len(set(t.split(b"\n"))) for t in raw], np.float64)
    caps = upper[starts]
    second = np.minimum(starts + 1, len(buf) - 1)
    return np.column_stack([
        np.log1p(counts), mean, np.sqrt(np.maximum(by_text(length * length) / some - mean * mean, 0)),
        by_text(length <= 3) / some, by_text(length >= 12) / some, per(upper) / size, per((buf >= 48) & (buf <= 57)) / size, per(marks) / size,
        per(marks & ~_PROSE[buf]) / size, per(buf >= 128) / size, per((buf == 46) | (buf == 33) | (buf == 63)) / some, per(buf == 44) / some,
        by_text(marks[ends]) / some, np.bincount(o[new], minlength=n) / some, by_text(next_same) / some, most / some,
        pair_kinds / np.maximum(pairs, 1), np.log1p(size / lines), kinds / lines, np.bincount(line_owner, weights=line_len < 20, minlength=n) / lines,
        per(buf == 124) / some, by_text(caps) / some, by_text(caps & upper[second]) / some, per(buf == 64) / some]).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and one binary vector of FEATURES (float32) for every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = S.Words(S.SPACE)
        for batch in slices(batches):
            x = text_features(texts(batch), words_of)
            yield pa.RecordBatch.from_pydict({"doc_id": col(batch, "doc_id"), "x": pa.array([r.tobytes() for r in x], type=pa.binary())})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, x binary")


# --- the model ---------------------------------------------------------------


def _bins(x: np.ndarray, most: int = 48) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, most + 1)[1:-1])) for c in x.T]


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)])


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram along its last axis
    (cut c: bins < c and the rest), summed over the other axes."""
    gl, hl = np.cumsum(g, axis=-1)[..., :-1], np.cumsum(h, axis=-1)[..., :-1]
    gr, hr = g.sum(axis=-1, keepdims=True) - gl, h.sum(axis=-1, keepdims=True) - hl
    gain = gl * gl / (hl + 1) + gr * gr / (hr + 1)
    gain = np.where((hl >= least) & (hr >= least), gain, -np.inf)
    if gain.ndim > 1:
        gain = gain.sum(axis=0)
    if not gain.size or not np.isfinite(gain.max()):
        return -np.inf, 0
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, least: float = 5.0) -> np.ndarray:
    """A shallow tree over one feature's bins, as the step for each bin."""
    whole = g.sum() ** 2 / (h.sum() + 1)
    gain, cut = _best_cut(g, h, least)
    if depth == 0 or gain <= whole:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, least), _tree(g[cut:], h[cut:], depth - 1, least)])


def _tree2(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two features: the best cut of each, four leaves."""
    _, a = _best_cut(g.sum(axis=1), h.sum(axis=1), 5.0)
    _, b = _best_cut(g.sum(axis=0), h.sum(axis=0), 5.0)
    out = np.zeros_like(g)
    for rows in (slice(0, a), slice(a, None)):
        for cols in (slice(0, b), slice(b, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, n_pairs: int = 10, pair_rounds: int = 80) -> dict:
    """Lookup tables per feature and per chosen pair, on the logit scale."""
    edges = _bins(x)
    b = _binned(x, edges)
    sizes = [len(e) + 1 for e in edges]
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    f = np.full(len(y), base)
    tables = [np.zeros(s) for s in sizes]
    for _ in range(rounds):
        for j, s in enumerate(sizes):
            p = 1 / (1 + np.exp(-f))
            step = rate * _tree(np.bincount(b[:, j], y - p, s), np.bincount(b[:, j], p * (1 - p), s))
            tables[j] += step
            f += step[b[:, j]]

    coarse = [np.minimum(np.arange(s) * 12 // s, 11) for s in sizes]
    c = np.column_stack([m[b[:, j]] for j, m in enumerate(coarse)])
    p = 1 / (1 + np.exp(-f))
    ranked = []
    for i in range(len(sizes)):
        for j in range(i):
            key = c[:, i] * 12 + c[:, j]
            g, h = (np.bincount(key, v, 144).reshape(12, 12) for v in (y - p, p * (1 - p)))
            t = _tree2(g, h)
            ranked.append((float((2 * g * t - h * t * t).sum()), i, j))
    pairs = [(i, j) for gain, i, j in sorted(ranked, reverse=True)[:n_pairs] if gain > 0]
    grids = [np.zeros((12, 12)) for _ in pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(pairs):
            p = 1 / (1 + np.exp(-f))
            key = c[:, i] * 12 + c[:, j]
            step = rate * _tree2(*(np.bincount(key, v, 144).reshape(12, 12) for v in (y - p, p * (1 - p))))
            grids[k] += step
            f += step.ravel()[key]
    return {"base": base, "edges": edges, "tables": tables, "coarse": coarse, "pairs": pairs, "grids": grids}


def score_gam(model: dict, x: np.ndarray) -> np.ndarray:
    b = _binned(x, model["edges"])
    f = np.full(len(x), model["base"])
    for j, t in enumerate(model["tables"]):
        f += t[b[:, j]]
    for (i, j), grid in zip(model["pairs"], model["grids"]):
        f += grid[model["coarse"][i][b[:, i]], model["coarse"][j][b[:, j]]]
    return 1 / (1 + np.exp(-f))


def fit_quality(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict | None:
    """Fit on labelled rows (doc_id, x) that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.avg("quality").alias("q")).select("doc_id", (F.col("q") > 0.5).cast("int").alias("y"))
    n = known.count()
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(19), "doc_id"), 12) / F.lit(float(1 << 52))
    some = known.where(chance < min(1.0, max_rows / max(n, 1))) if n > max_rows else known
    sample = [(str(r.doc_id), bytes(r.x), r.y) for r in rows.join(some, "doc_id").select("doc_id", "x", "y").toLocalIterator()]
    if not sample:
        return None
    sample.sort()
    x = np.frombuffer(b"".join(s[1] for s in sample), np.float32).reshape(len(sample), len(FEATURES))
    return fit_gam(x, np.array([s[2] for s in sample], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, score (0 to 1, the chance of label 1): one row per input row."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = stage(features(docs), "quality-features")
    model = fit_quality(rows, labels, max_rows)
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(col(batch, "x").to_pylist()), np.float32).reshape(batch.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_pydict({"doc_id": col(batch, "doc_id"), "score": pa.array(score_gam(shared.value, x))})

    return rows.mapInArrow(score, f"doc_id {kind}, score double")
