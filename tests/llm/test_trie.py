"""The prefix trie against a plain recomputation."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lendframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, (role or ""), (text or "")))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    turns = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[0], x[1], md5(x[2]), md5(x[3])))] for c, v in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in children[k])
    return sorted(((
        min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed, n, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-10, 3 * n), n):
        for t in range(rng.choice([0, 1, 2, 3, 8, longest])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(words)))
    return rows


@pytest.mark.parametrize("seed, n, longest, words", [(1, 60, 20, ["a"]), (2, 60, 12, ["a", "b", ""]), (3, 12, 90, ["a", "ü b"])])
def test_equals_brute_force(spark, seed, n, longest, words):
    rows = conversations(seed, n, longest, words)
    random.Random(seed).shuffle(rows)
    assert result(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, "user", "no number first"), (0, 1, None, None), (0, 1, "user", "tie"), (0, 1, "user", "tie"), (0, 2, "user", ""),
        (1, 0, "user", "only"), (7, 0, "user", "base absent"), (7, 1, "user", "two"), (-3, 0, "user", "x"), (None, 0, "user", "nobody"),
        (5, 5, "user", "x" * 100_000), (6, 5, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(trie.prefix_trie(df)) == brute(rows)
    wide = df.withColumns({c: F.lit("x") for c in ("depth", "a", "b", "slice", "n", "h", "lead", "kids", "base", "pos")})
    assert result(trie.prefix_trie(wide)) == brute(rows)
    assert trie.prefix_trie(df.limit(0)).collect() == []


def test_one_conversation_of_very_many_turns_and_one_node_of_very_many_ends(spark, monkeypatch):
    rows = [(3, t, "user", f"turn {t}") for t in range(700)] + [(5 * c, 0, "user", "same") for c in range(1, 300)]
    assert result(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(8))) == brute(rows)


def test_sha_of_one_key_spread_over_partitions(spark):
    ids = spark.range(1, 100_000).select(F.lit(7).cast("long").alias("k"), "id")
    (row,) = trie.ordered_sha256(ids.unionByName(spark.range(0).select(F.col("id").alias("k"), "id")), ["k"], "id").collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(1, 100_000))).encode()).hexdigest()


def test_subtree_totals_of_a_chain_a_star_and_a_comb(spark):
    chain = [(0, d, 0 if d else None, 1 if d < 99 else 0, 1) for d in range(100)]
    star = [(0, 0, None, 50, 1)] + [(c, 1, 0, 0, 1) for c in range(50)]
    comb = [(0, d, 0 if d else None, 2 if d < 40 else 0, 1) for d in range(41)] + [(c, c, 0, 0, 1) for c in range(1, 41)]
    for nodes in (chain, star, comb):
        df = spark.createDataFrame(nodes, "conv_id long, depth long, parent_conv_id long, n_children long, v long")
        below = defaultdict(int)
        for c, d, p, _, v in sorted(nodes, key=lambda n: -n[1]):
            below[(c, d)] += v
            if p is not None:
                below[(p, d - 1)] += below[(c, d)]
        assert {(r.conv_id, r.depth): r.v for r in trie.subtree_totals(df, ["v"]).collect()} == dict(below)
