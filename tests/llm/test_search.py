"""Ranked search against a plain recomputation."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lendframe.llm import search

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text):
    return re.findall(search.TERM, (text or "").translate(str.maketrans(_UP, _LOW)))


def brute(docs, items, k=search.TOP):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_all = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = {}
    held = {}
    for i, t in items:
        held.setdefault(i, set()).update(terms(t))
    for i, wanted in held.items():
        scores = []
        for d, c in counted:
            n = sum(c.values())
            total = 0
            for t in wanted & set(c):
                m = 100 - 50 + (50 * n * n_docs) // n_all
                total += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if total > 0:
                scores.append((-total, d is None, d or 0, d))
        out[i] = [(r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return {i: v for i, v in out.items() if v}


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


DOCS = [
    (1, "The cat sat on the mat."), (2, "CAT cat cat!"), (3, None), (4, "  ... ,,, "), (5, "dog à la carte, \x85\xa0 voilà"),
    (6, "the the the the"), (6, "the the the the"), (7, "a-b_c"), (None, "cat and dog"), (None, "cat and dog"), (8, "catalog concat scat"),
    (9, "É cat é " * 5000), (10, "\x00cat\x7fdog\x1c")]
ITEMS = [(1, "Cat, dog"), (1, "mat mat"), (2, "the à"), (3, None), (4, "?!"), (5, "voilà \x85\xa0"), (6, "b scat"), (None, "DOG"), (7, "nowhere")]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [search.BLOCK_BYTES, 6])
def test_equals_brute_force_on_odd_rows(spark, block_bytes):
    docs, items = frames(spark, DOCS, ITEMS)
    assert ranked(search.rank_documents(docs, items, block_bytes=block_bytes)) == brute(DOCS, ITEMS)


def test_top_k_ties_go_by_doc_id(spark):
    rows = [(i, "same words here") for i in range(400)] + [(None, "same words here")]
    docs, items = frames(spark, rows, [(1, "words"), (2, "here same")])
    found = ranked(search.rank_documents(docs.repartition(7), items, k=5))
    assert found == brute(rows, [(1, "words"), (2, "here same")], 5)
    assert [d for _, d, _ in found[1]] == [0, 1, 2, 3, 4]


def test_empty_sides_and_clashing_columns(spark):
    from pyspark.sql import functions as F
    docs, items = frames(spark, DOCS, ITEMS)
    none, no_items = frames(spark, [], [])
    assert search.rank_documents(none, items).collect() == [] and search.rank_documents(docs, no_items).collect() == []
    assert search.rank_documents(docs.where("doc_id in (3, 4)"), items).collect() == []
    wide = docs.withColumns({c: F.lit("x") for c in ("item", "score", "rank", "slot", "term", "block")})
    wide_items = items.withColumns({c: F.lit("x") for c in ("doc_id", "score", "term", "terms", "block")})
    assert ranked(search.rank_documents(wide, wide_items)) == brute(DOCS, ITEMS)


def test_a_term_is_found_only_between_guards():
    own = search.Terms([(0, ["cat", "b"]), (1, ["cat"])])
    total, row, term, tf = search.term_counts(own.automaton(), [b"cat cat concat b", b"", b"scat", "é cat".encode()], 2)
    assert total.tolist() == [4, 0, 1, 2]
    assert [(r, own.terms[t], n) for r, t, n in zip(row, term, tf)] == [(0, "b", 1), (0, "cat", 2), (3, "cat", 1)]
    assert own.item_of[own.first[1]: own.first[2]].tolist() == [0, 1]


def test_best_keeps_ties_and_prunes():
    best = search.Best(1, 3)
    zero = np.zeros(4, np.int64)
    best.add(zero, np.array([5, 5, 5, 5]), np.array([9, 8, 7, 6]), zero)
    assert best.prune()[2].tolist() == [6, 7, 8]
    best.add(zero[:2], np.array([5, 4]), np.array([1, 0]), zero[:2])
    assert best.prune()[2].tolist() == [1, 6, 7]
