"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (per-coordinate
FTRL-proximal, elastic-net penalties) and calibrated by one temperature.

N-grams of 1 to 3 characters, lower-cased, are hashed into ``DIM`` columns.  A
document is its hashed counts, 1 + ln(count), times idf, scaled to length 1.

Learning reads only rows with a language that are not held out
(``common.held_out``).  Document frequencies are counted over all of those
rows; the weights are fitted on a sample of at most ``max_rows`` of them in
expectation, spread evenly over the languages and chosen by a hash of doc_id,
and the temperature on every fifth row of that sample.

A model is a dictionary of a few arrays (DIM x languages); it is sent to the
tasks that score.  Edge cases: null text, or text without any letter, is
``und`` with score 0; without any row to learn from, every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm.common import col, held_out, merge_vectors, slices

DIM = 1 << 13
ORDERS = (1, 2, 3)
#: Bound on the labelled rows the weights are fitted on.
MAX_TRAIN_ROWS = 6000
#: Texts whose n-grams are counted at once (each is a row of DIM numbers, however short).
BATCH_TEXTS = 256
UNKNOWN = "und"
_MULT = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_CHARS = 1 << 18


def gram_counts(raw: list[str]) -> np.ndarray:
    """Texts x DIM counts of hashed character n-grams (float32)."""
    out = np.zeros((len(raw), DIM), np.float32)
    # blocks of whole texts, or of pieces of one long text that overlap by the longest n-gram
    block: list[str] = []
    rows: list[int] = []
    size = 0
    longest = max(ORDERS) - 1

    def add() -> None:
        points = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.array([len(t) for t in block])
        owner = np.repeat(np.array(rows, np.int64), lengths)
        stop = np.repeat(np.cumsum(lengths), lengths)
        fresh = np.repeat(np.array(skip), lengths)
        place = np.arange(len(points))
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        h = np.zeros(len(points), np.uint64)
        for n in ORDERS:
            tail = points[n - 1:]
            h[: len(tail)] = (h[: len(tail)] + tail + np.uint64(n)) * _MULT[n - 1]
            # an n-gram inside the overlap was counted with the piece before
            ok = (place + n <= stop) & ((place - begin + n > fresh))
            cell = (h[ok] >> np.uint64(64 - 13)).astype(np.int64)
            width = rows[-1] - rows[0] + 1
            counted = np.bincount((owner[ok] - rows[0]) * DIM + cell, minlength=width * DIM)
            out[rows[0]: rows[-1] + 1] += counted.reshape(width, DIM)

    skip: list[int] = []
    for i, text in enumerate(raw):
        at = 0
        while at < len(text):
            back = longest if at else 0
            piece = text[at - back: at + _CHARS]
            if block and (size + len(piece) > _CHARS or len(block) >= 64):
                add()
                block, rows, skip, size = [], [], [], 0
            block.append(piece)
            rows.append(i)
            skip.append(back)
            size += len(piece)
            at += _CHARS
    if block:
        add()
    return out


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def _lowered(batch: pa.RecordBatch) -> list[str]:
    return [(t or "").lower() for t in col(batch, "text").to_pylist()]


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the rows hold each column, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches, rows=BATCH_TEXTS):
            seen = (gram_counts(_lowered(batch)) > 0).sum(axis=0)
            seen = np.append(seen, batch.num_rows).astype(np.int64)
            total = seen if total is None else total + seen
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["v"])

    total = merge_vectors(rows.select("text").mapInArrow(count, "v binary"), "v", "int64", "sum", groups=12)
    return (np.zeros(DIM, np.int64), 0) if total is None else (total[:-1], int(total[-1]))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, n_classes: int, epochs: int = 4, alpha: float = 0.5,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, batch: int = 16, seed: int = 3) -> np.ndarray:
    """FTRL-proximal for softmax regression; columns whose gradients stay
    within ``l1`` get weight exactly 0.  A row is its (columns, values); the
    intercept is column ``width``, which no row lists."""
    z, n = np.zeros((width + 1, n_classes)), np.zeros((width + 1, n_classes))
    draw = np.random.Generator(np.random.PCG64(seed))

    def weights(zz, nn):
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at: at + batch]
            used, xs = dense([rows[i] for i in some], width)
            w = weights(z[used], n[used])
            logits = xs @ w
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            g = xs.T @ p
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * w
            n[used] += g * g
    return weights(z, n)


def dense(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns that any of a few rows uses, the intercept's last, and the
    rows' values in them."""
    used = np.append(np.unique(np.concatenate([c for c, _ in rows])), width).astype(np.int64)
    xs = np.zeros((len(rows), len(used)), np.float32)
    xs[:, -1] = 1
    for x, (cells, values) in zip(xs, rows):
        x[np.searchsorted(used, cells)] = values
    return used, xs


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature that minimises the log loss (golden section on its
    log).  Labels count as wrong once in n + 1, so that a sample without errors
    does not make the scores certain."""
    n, k = logits.shape
    target = np.full((n, k), 1 / ((n + 1) * max(k - 1, 1)))
    target[np.arange(n), y] = n / (n + 1)

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean((target * (np.log(np.exp(s).sum(axis=1, keepdims=True)) - s)).sum(axis=1)))

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language_model(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict | None:
    """The model, or None if there is nothing to learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per_lang = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not per_lang:
        return None
    langs = sorted(per_lang)
    rates = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, max_rows / len(langs) / per_lang[lang]))])
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id"), 12) / F.lit(float(1 << 52))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=BATCH_TEXTS):
            counts = gram_counts(_lowered(batch))
            where = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": col(batch, "doc_id").cast(pa.string()), "lang": col(batch, "lang"),
                "cells": pa.array([w.astype(np.int16).tobytes() for w in where], type=pa.binary()),
                "counts": pa.array([c[w].astype(np.float32).tobytes() for c, w in zip(counts, where)], type=pa.binary())})

    chosen = known.where(chance < F.element_at(rates, F.col("lang")))
    df, n_rows = document_frequencies(known)
    idf = (np.log((1 + n_rows) / (1 + df)) + 1).astype(np.float32)
    sample = []
    for r in chosen.mapInArrow(features, "doc_id string, lang string, cells binary, counts binary").toLocalIterator():
        cells = np.frombuffer(r.cells, np.int16)  # rows stay sparse on the driver
        sample.append((r.doc_id, langs.index(r.lang), cells, tfidf(np.frombuffer(r.counts, np.float32)[None, :], idf[cells])[0]))
    sample.sort(key=lambda r: r[0])
    fit, check = [r for i, r in enumerate(sample) if i % 5 != 4], sample[4::5]
    weights = ftrl([r[2:] for r in fit], np.array([r[1] for r in fit], np.int64), DIM, len(langs)) if fit else np.zeros((DIM + 1, len(langs)))
    temperature = 1.0
    if check:
        logits = np.array([values @ weights[cells] + weights[DIM] for _, _, cells, values in check])
        temperature = fit_temperature(logits, np.array([r[1] for r in check], np.int64))
    return {"langs": langs, "idf": idf, "weights": weights.astype(np.float32), "temperature": temperature}


def _chances(m: dict, batch: pa.RecordBatch) -> np.ndarray:
    """Calibrated probabilities of a batch's texts, texts x languages."""
    logits = tfidf(gram_counts(_lowered(batch)), m["idf"]) @ m["weights"][:-1] + m["weights"][-1]
    s = logits.astype(np.float64) / m["temperature"]
    p = np.exp(s - s.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def predict_language(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, row_hash, lang_pred, score: one row per input row."""
    kind = dict(docs.dtypes)["doc_id"]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), letters.alias("letters"), F.when(letters, F.col("text")).alias("text"))
    if model is None:
        return rows.select("doc_id", "row_hash", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array(m["langs"], dtype=object)
        for batch in slices(batches, rows=BATCH_TEXTS):
            p = _chances(m, batch)
            known = np.asarray(col(batch, "letters").to_pylist(), bool)
            yield pa.RecordBatch.from_pydict({
                "doc_id": col(batch, "doc_id"), "row_hash": col(batch, "row_hash"),
                "lang_pred": pa.array(np.where(known, names[p.argmax(axis=1)], UNKNOWN).tolist(), type=pa.string()),
                "score": pa.array(np.where(known, p.max(axis=1), 0.0))})

    return rows.mapInArrow(score, f"doc_id {kind}, row_hash long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs`` (all columns) for which ``predict_language`` has a language: null and
    letterless texts go, whatever their other columns.  Rows are filtered where they are read: no
    shuffle.  Without a model (no labelled language at all) every text with a letter stays."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.where(letters)
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value["langs"], dtype=object)
        for batch in slices(batches, rows=BATCH_TEXTS):
            found = names[_chances(shared.value, batch).argmax(axis=1)]
            yield batch.filter(pa.array(found != UNKNOWN)).select(columns)

    return docs.where(letters).mapInArrow(keep, docs.schema)
