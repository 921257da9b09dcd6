"""The registered queries against their SQL, and the pipeline."""

import collections

import corpus_pipeline
import pytest
from conftest import SF_SMALL

from lendframe.llm import common
from lendframe.llm.oracles import ORACLES
from lendframe.llm.queries import QUERIES
from lendframe.plans.check import _norm, duckdb_rows

COLUMNS = {
    "op1_quality": {"doc_id", "held_out", "score", "predicted"},
    "op2_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
    "op3_ngram_join": {"doc_id", "n_shingles", "component_id"},
    "op4_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op5_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op7_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op8_decontamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op9_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op11_prefix_trie": {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"},
    "op12_search": {"item_id", "rank", "doc_id", "score"},
    "op13_suffix_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op10_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    cols, rows = duckdb_rows(ORACLES[name], SF_SMALL)
    assert sorted(df.columns) == sorted(cols)
    mine = collections.Counter(tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    assert mine == collections.Counter(tuple(_norm(r[cols.index(c)]) for c in sorted(cols)) for r in rows)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_one_row_per_document(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert COLUMNS[name] <= set(df.columns)
    if name not in ("op11_prefix_trie", "op12_search"):
        assert df.count() == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()


def test_entry_registers_all():
    import __spark_entry__ as entry
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, held = docs.columns, []
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, SF_SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        held.append(docs)
        if i < 4:
            assert docs.columns == columns
    ids = [collections.Counter(r.doc_id for r in d.select("doc_id").collect()) for d in held]
    assert set(ids[1]) <= set(ids[0]) and set(ids[2]) <= set(ids[1]) and set(ids[3]) <= set(ids[2]) and ids[4] == ids[3]
    assert set(ids[1].values()) == {1} and max(ids[3].values()) <= 3
    from lendframe.llm import decontam, ngram_join
    from fractions import Fraction
    again = ngram_join.jaccard_classes(held[1], 5, Fraction(8, 10)).collect()
    assert all(r.doc_id == r.component_id for r in again)
    lettered = docs.sparkSession.read.parquet(f"{SF_SMALL}/documents.parquet").where("text rlike '[[:alpha:]]'")
    assert set(ids[0]) >= {r.doc_id for r in lettered.select("doc_id").collect()}  # only what has no language goes
    bench = common.table(spark, SF_SMALL, "benchmark")
    left = decontam.find_contamination(held[2], bench)
    assert left.where(decontam.contaminated(left["n_words"], left["n_hit"])).count() == 0


def test_pipeline_on_odd_and_empty_rows(spark, odd, empty, tmp_path):
    for n, docs in enumerate((odd, empty)):
        for i, (_, step) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{n}-{i}")
            step(spark, docs, SF_SMALL).write.parquet(path)
            docs = spark.read.parquet(path)
        assert (docs.count() > 0) == (n == 0)


NAMES = ["__letters", "__row_hash", "__nth", "__copies", "__hash", "__doc_id", "__copy", "row", "h", "k", "worded", "key_id", "key_hash", "copies", "row_hash", "col"]


def test_stages_leave_columns_of_any_name_alone(spark, make, tmp_path):
    from pyspark.sql import functions as F
    text = "a clean text of more than five words about nothing in particular"
    rows = [(1, text, "en", "s", 1), (2, text + " but longer", "en", "s", 1), (3, "other words that have nothing to do with the first ones", "en", "t", 1), (None, "words without an id in a row", "en", None, 1)]
    docs = make(rows).withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id"), F.lit(0))) for n in NAMES})
    columns = docs.columns
    for i, (_, step) in enumerate(corpus_pipeline.STAGES[:4]):
        step(spark, docs, SF_SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns
        assert docs.count() >= 3
        for r in docs.collect():
            assert all(r[n] == f"{n}{r.doc_id or 0}" for n in NAMES)


def test_two_texts_under_one_id_both_stay_and_copies_without_an_id_are_one(spark, make):
    draw = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, draw("a"), "en", "s", 1), (1, draw("b"), "en", "s", 1), (2, draw("a"), "en", "s", 1), (3, draw("b") + " end", "en", "s", 1),
            (None, draw("c"), "en", "s", 1), (None, draw("c"), "en", "s", 1), (4, "", "en", "s", 1), (5, "", "en", "s", 1), (6, None, "en", "s", 1), (7, " \t", "en", "s", 1)]
    kept = corpus_pipeline.drop_near_duplicates(spark, make(rows), SF_SMALL).collect()
    assert sorted(((r.text or "")[:1]) for r in kept if (r.text or "").strip()) == ["a", "b", "c"]
    assert sorted(r.doc_id for r in kept if not (r.text or "").strip()) == [4, 5, 6, 7]
