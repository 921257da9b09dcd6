"""Secret scan: findings in whole texts, and a random forest that removes the
false positives.

A finding is a run of at least ``MIN_CHARS`` characters of
``[A-Za-z0-9+/_-]`` (without the hyphens it begins with) and up to two ``=`` at its end, or the value of any
length that is assigned to a credential name: the characters up to the next
space, or to the closing quote if it is quoted, without closing punctuation
(each with its context of up to ``CONTEXT`` characters on both sides).  What both rules find is one finding.
Its features: length; character transitions (how often the class of
character changes, how evenly characters are used, shares of digits, capitals
and marks); dictionary coverage (the share of its letters in runs that are
common words of the corpus); whether it looks like a path or address; and the
neighbouring words (a credential word before it, an assignment, quotes).

The forest is Spark ML's, trained on labelled findings (a table of findings
with ``label`` 1 or 0).  Where none is given, ``label_findings`` labels those
that fixed rules decide: known key formats and values assigned to a credential
name are secrets, findings made of letters only or of common words are not;
the rest stays unlabelled and is what the forest is for.  At most
``MAX_TRAIN_ROWS`` labelled findings in expectation are used.

Edge cases: null or empty text has no findings; with labels of one kind only
the label is the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lendframe.llm import shingles as S
from lendframe.llm.common import col, slices, stage
from lendframe.llm.ngram_join import ORDER_BITS, shingle_counts

MIN_CHARS = 15
CONTEXT = 40
MAX_TRAIN_ROWS = 20000
#: Names that are followed by credentials.
CREDENTIAL = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)"
#: Formats of well-known keys.
KNOWN_FORMAT = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{24,}|AIza[A-Za-z0-9_-]{35})$"
FEATURES = ("n_chars", "changes", "evenness", "digits", "capitals", "marks", "vowels", "coverage", "path", "credential", "assigned", "quoted")
_FINDING = re.compile(r"(?<![A-Za-z0-9+/_])[A-Za-z0-9+/_][A-Za-z0-9+/_-]{%d,}={0,2}" % (MIN_CHARS - 1))
#: A name (a whole run, so that long runs are read once) and what assigns to it.
_ASSIGNMENT = re.compile(r"(?<![\w-])([\w-]++)[\"'\]]*+\s*+(?::=|=>|==?|:)\s*+")
_QUOTED = {q: re.compile(r"%s((?:\\.|[^\s\\%s])++)%s" % (q, q, q)) for q in "\"'`"}
_VALUE = re.compile(r"\S+")
_CREDENTIAL = re.compile(CREDENTIAL)
_CLOSING = "\"'`.,;:)]}>"


def spans(text: str) -> list[tuple[int, int]]:
    """Where the findings of a text begin and end, in order.  Long runs begin
    where a run does, and assigned values don't overlap each other."""
    found = {m.span() for m in _FINDING.finditer(text)}
    at = 0
    while m := _ASSIGNMENT.search(text, at):
        at = m.end()
        if not _CREDENTIAL.search(m[1]) or at == len(text):
            continue
        quote = _QUOTED.get(text[at])
        if quote and (closed := quote.match(text, at)):
            found.add(closed.span(1))
            at = closed.end()
        elif whole := _VALUE.match(text, at + bool(quote)):
            at = whole.end()
            value = whole[0].rstrip(_CLOSING)
            if value:
                found.add((whole.start(), whole.start() + len(value)))
    return sorted(found)


def _classes(value: str) -> list[int]:
    return [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]


def describe(value: str, before: str, after: str, known) -> list[float]:
    """The features of one finding; ``known`` tells whether a word is common."""
    n, kinds = len(value), _classes(value)
    counts = np.array([value.count(c) for c in set(value)], float)
    share = counts / n
    runs = re.findall(r"[A-Za-z]{3,}", value)
    covered = sum(len(r) for r, ok in zip(runs, known([r.lower().encode() for r in runs])) if ok) if runs else 0
    letters = max(1, sum(k in (1, 2) for k in kinds))
    return [
        float(n), sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), float(-(share * np.log2(share)).sum()),
        kinds.count(0) / n, kinds.count(2) / n, kinds.count(3) / n, sum(c in "aeiouAEIOU" for c in value) / letters, covered / letters,
        float("/" in value.strip("/=") or bool(re.search(r"(://|www\.|[\w-]+\.[a-z]{2,4}/)\S*$", before))),
        float(bool(re.search(CREDENTIAL, before[-24:]))), float(bool(re.search(r"(=>|[=:])\s*[\"'`]?$", before))),
        float(before[-1:] in "\"'" and before[-1:] != "" and after[:1] == before[-1:])]


def findings(docs: DataFrame, min_share: float = 1e-3) -> DataFrame:
    """doc_id, row_hash, start, value, before, and the features of every
    finding of every whole text.  A word is common if its cell of the corpus's
    word table counts more than the average cell by ``min_share`` of all
    documents."""
    kind = dict(docs.dtypes)["doc_id"]
    counts = shingle_counts(docs, 1)
    common = counts > counts.mean() + 3 * np.sqrt(counts.mean()) + min_share * docs.count()
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(common))
    schema = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("row_hash", pa.int64()), ("start", pa.int64()),
                        ("value", pa.string()), ("before", pa.string())] + [(f, pa.float64()) for f in FEATURES])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, bits = S.Words(S.SPACE), np.unpackbits(shared.value).astype(bool)

        def known(words: list[bytes]) -> np.ndarray:
            hashes, _ = S.shingles(*words_of(words), 1)
            return bits[(hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]

        for batch in slices(batches):
            out = []
            for doc_id, row_hash, text in zip(*(col(batch, c).to_pylist() for c in ("doc_id", "row_hash", "text"))):
                for start, end in spans(text or ""):
                    value, before, after = text[start:end], text[max(0, start - CONTEXT): start], text[end: end + CONTEXT]
                    out.append([doc_id, row_hash, start, value, before, *describe(value, before, after, known)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id {kind}, row_hash long, start long, value string, before string, " + ", ".join(f"{f} double" for f in FEATURES))


def label_findings(found: DataFrame) -> DataFrame:
    """``label`` by rule: 1, 0 or null (not decided)."""
    value: Column = F.col("value")
    assigned = (F.col("credential") > 0) & (F.col("assigned") > 0) & (F.col("digits") > 0) & (F.col("coverage") < 0.3)
    return found.withColumn(
        "label", F.when(value.rlike(KNOWN_FORMAT) | assigned, 1.0).when((F.col("digits") == 0) & (F.col("marks") == 0) | (F.col("coverage") >= 0.5), 0.0))


def fit_forest(labelled: DataFrame, max_rows: int = MAX_TRAIN_ROWS, trees: int = 30, depth: int = 6, seed: int = 13):
    """The forest, or the only label there is (0.0 if none)."""
    known = labelled.where("label is not null")
    per_label = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two labels
    if len(per_label) < 2:
        return next(iter(per_label), 0.0)
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(23), "doc_id", "start", "value"), 12) / F.lit(float(1 << 52))
    rate = F.when(F.col("label") == 1, min(1.0, max_rows / 2 / per_label[1.0])).otherwise(min(1.0, max_rows / 2 / per_label[0.0]))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known.where(chance < rate))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features", probabilityCol="chances")
    # A copy has no training summary.  The summary holds the session, which Spark can't send to
    # the executors once an ``Observation`` was used in it.
    return forest.fit(rows.select("features", "label")).copy()


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Every finding: doc_id, row_hash, start (code points), value, score, is_secret."""
    found = stage(findings(docs), "findings")
    model = fit_forest(label_findings(found) if labelled is None else labelled)
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
        scored = model.transform(ready).withColumn("score", vector_to_array("chances")[1])
    return scored.select("doc_id", "row_hash", "start", "value", "score", (F.col("score") >= threshold).alias("is_secret"))
