"""Vocabulary, token id windows and mini-batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lendframe.operators import batches as B
from lendframe.operators import tokens as TK


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, tokens array<string>")


def test_vocabulary_is_by_count_then_token_whatever_the_partitions(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 9))]) for i in range(300)] + [(300, None), (301, [None, "a"])]
    counts = Counter(t for _, ts in rows for t in ts or [] if t is not None)
    want = [(i + 2, t, n) for i, (t, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))]
    for parts in (1, 7):
        found = TK.fit_vocabulary(frame(spark, rows).repartition(parts), ["tokens"], num_partitions=parts)
        assert sorted(map(tuple, found.collect())) == want
    few = TK.fit_vocabulary(frame(spark, rows), ["tokens"], min_count=20, max_size=5)
    assert sorted(map(tuple, few.collect())) == [w for w in want if w[2] >= 20][:5]


@pytest.mark.parametrize("frequent", [0, 2, 4096])
def test_ids_keep_their_order_and_are_cut_and_padded(spark, frequent):
    words = spark.createDataFrame([(2, "a", 9), (3, "b", 5), (4, "c", 1)], "token_id long, token string, n long")
    rows = [(1, ["c", "a", "x", "a"]), (2, ["b"] * 9), (3, []), (4, None), (5, ["a", None])]
    found = {r.k: (r.input_ids, r.attention_mask) for r in TK.token_ids(frame(spark, rows), ["k"], "tokens", words, 5, frequent=frequent).collect()}
    assert found == {
        1: ([4, 2, 1, 2, 0], [1, 1, 1, 1, 0]), 2: ([3] * 5, [1] * 5), 3: ([0] * 5, [0] * 5), 4: ([0] * 5, [0] * 5), 5: ([2, 1, 0, 0, 0], [1, 1, 0, 0, 0])}


def test_a_token_in_every_row_is_not_shuffled_by_token(spark):
    words = TK.fit_vocabulary(frame(spark, [(1, ["hot", "cold"])]), ["tokens"])
    plan = TK.token_ids(frame(spark, [(1, ["hot"])]), ["k"], "tokens", words, 4)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "PythonUDF" not in plan


def test_every_row_once_in_each_epoch_in_batches_of_one_size(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k").withColumn("v", F.col("k") * 2)
    found = [tuple(r) for r in B.epoch_batches(rows, "k", [1, 2], 64, seed=3).collect()]
    again = [tuple(r) for r in B.epoch_batches(rows.repartition(5), "k", [1, 2], 64, seed=3, num_partitions=3).collect()]
    assert sorted(found) == sorted(again)
    orders = {}
    for e in (1, 2):
        own = sorted((b, s, k) for ep, b, s, k, v in found if ep == e and v == 2 * k)
        assert sorted(k for *_, k in own) == list(range(1000))
        assert [(b, s) for b, s, _ in own] == [(i // 64, i % 64) for i in range(1000)]
        orders[e] = [k for *_, k in own]
    assert orders[1] != orders[2]
    other = [r.k for r in B.epoch_batches(rows, "k", [1], 64, seed=4).orderBy("batch", "slot").collect()]
    assert other != orders[1]


def test_ordered_batches_follow_the_key_and_names_must_not_clash(spark):
    rows = spark.range(300, 0, -1).withColumnRenamed("id", "k").repartition(4)
    found = [tuple(r) for r in B.ordered_batches(rows, "k", 128).collect()]
    assert sorted(found) == [(i // 128, i % 128, i + 1) for i in range(300)]
    assert B.ordered_batches(rows.limit(0), "k", 128).collect() == [] and B.epoch_batches(rows.limit(0), "k", [1], 8).collect() == []
    with pytest.raises(ValueError):
        B.epoch_batches(rows.withColumn("slot", F.lit(1)), "k", [1], 8)


def test_dictionary_ids_do_not_depend_on_partitions_when_loan_ids_repeat(spark):
    from lendframe.operators import category as C
    rows = spark.createDataFrame([(i % 50, f"town {i:03d}") for i in range(200)], "LOAN_ID long, TOWN_NAME string")
    found = [sorted(map(tuple, C.fit_dictionary(rows.repartition(n), ["TOWN_NAME"], num_partitions=n).collect())) for n in (2, 7)]
    assert found[0] == found[1] and len(found[0]) == 200
