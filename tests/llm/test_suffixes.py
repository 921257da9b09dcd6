"""Removal of repeated passages against a plain recomputation."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.llm import suffixes


def brute(rows):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - 49):
            if d is not None:
                first[raw[p: p + 50]] = min(first.get(raw[p: p + 50], d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            low = first.get(raw[p: p + 50])
            if low is not None and (d is None or low < d):
                gone[p: p + 50] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[0] if len(gone) else 0))
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.span_starts), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def documents(seed, n=60):
    """Prose of few syllables, shared passages, edited and exact copies, runs of one character."""
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choice(["ab", "c", "dé", " ", "the ", "ion", "\n"]) for _ in range(k))
    passages = [prose(rng.randint(15, 120)) for _ in range(6)] + ["=" * 70, "xy" * 60]
    rows = []
    for d in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            text = rng.choice(rows)[1]
        elif kind < 0.4 and rows:
            text = list(rng.choice(rows)[1] or "x")
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice("qz")
            text = "".join(text)
        else:
            text = "".join(prose(rng.randint(0, 60)) + (rng.choice(passages) if rng.random() < 0.5 else "") for _ in range(4))
        rows.append((d * 3 % 61, text))
    return rows


ODD = [
    (1, None), (2, ""), (3, "a" * 49), (4, "a" * 50), (5, "a" * 50), (6, "a" * 200), (6, "a" * 200), (7, "a" * 51), (None, "a" * 60), (None, "b" * 60), (None, "b" * 60),
    (8, "漢字é " * 40), (9, "字é 漢" * 40), (10, "b" * 60), (11, "b" * 30 + "c" * 40), (11, "c" * 60)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = documents(seed)
    assert result(suffixes.remove_repeats(frame(spark, rows).repartition(4))) == brute(rows)


def test_large_buckets_take_the_other_way_to_the_same_result(spark):
    rows = documents(4)
    assert result(suffixes.remove_repeats(frame(spark, rows), bucket_rows=1)) == brute(rows)


def test_odd_rows_empty_tables_and_clashing_columns(spark, odd, clashing):
    assert result(suffixes.remove_repeats(frame(spark, ODD))) == brute(ODD)
    for df in (odd, clashing):
        assert result(suffixes.remove_repeats(df)) == brute([(r.doc_id, r.text) for r in df.collect()])
    wide = frame(spark, ODD).withColumns({c: F.lit("x") for c in ("d", "h", "h2", "salt", "first", "last", "start", "copy", "ranges", "anchors")})
    assert result(suffixes.remove_repeats(wide)) == brute(ODD)
    assert suffixes.remove_repeats(frame(spark, [])).collect() == []


def test_very_long_text_and_a_passage_in_it(spark):
    rng = random.Random(5)
    long_text = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long_text[700_000:700_060]), (2, long_text), (3, long_text[600_000:600_049] + "!"), (4, "x" + long_text[524_250:524_340])]
    found = {r.doc_id: r for r in suffixes.remove_repeats(frame(spark, rows)).collect()}
    assert (found[2].span_starts, found[2].span_ends) == ([700_000], [700_060])
    assert found[3].n_removed == 0 and found[1].n_removed == 0
    assert (found[4].span_starts, found[4].span_ends, found[4].kept) == ([1], [91], b"x")


def test_anchors_of_equal_windows_are_equal_wherever_they_lie():
    rng = random.Random(6)
    passage = bytes(rng.choice(b"abc \n") for _ in range(300))
    texts = [passage, b"y" * 77 + passage, passage[10:70], b"short", bytes(rng.choice(b"ab") for _ in range(500)) + passage + b"tail"]
    owner, start, stop, value = suffixes.anchors(texts)
    at = {}
    for o, s, e, v in zip(owner, start, stop, value):
        for p in range(s, e):
            assert at.setdefault((o, p), v) == v
    for o, t in enumerate(texts):
        assert {p for oo, p in at if oo == o} == set(range(max(0, len(t) - 49)))
    seen = {}
    for (o, p), v in at.items():
        assert seen.setdefault(texts[o][p: p + 50], v) == v


@pytest.mark.parametrize("seed", range(5))
def test_longest_previous_equals_all_pairs(seed):
    rng = random.Random(seed)
    snippets = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 58))) for _ in range(12)]
    snippets += [snippets[0], snippets[1][:52] + b"zzz"]
    words, row, place = suffixes._windows(snippets)
    doc = np.array([rng.randrange(6) for _ in snippets])[row]
    group = (row % 2).astype(np.int64)
    found = suffixes.longest_previous(words, doc, group, need=1)
    windows = [snippets[r][p: p + 50] for r, p in zip(row, place)]

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 50)
    for i in range(len(windows)):
        assert found[i] == max((common(windows[i], windows[j]) for j in range(len(windows)) if doc[j] < doc[i] and group[j] == group[i]), default=0)
