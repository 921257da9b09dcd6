"""A training-data pipeline over ``documents``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  Its result must
be written before the next stage is called (``run`` and any other driver of
``STAGES`` write it as Parquet and read it again), because a stage deletes the
scratch tables of the stage before it.

1. language: texts without a language (null, or without a letter) go;
2. near_duplicates: one document of each group of linked ones stays;
3. decontamination: documents that repeat benchmark passages go;
4. mixing: documents appear as often as the mix takes them;
5. sharding: shuffled into shards, with ``shard`` and ``slot``.

All but the last return the columns of their input, whatever these are called.
The second stage links texts, not ids: two texts under one doc_id are two
documents, and copies without a doc_id are linked as well.  Texts are known by a
64-bit hash there.
"""

from __future__ import annotations

import threading
import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.llm import common, decontam, language, mixing, ngram_join, sharding
from lendframe.session import ensure_checkpoint_dir

#: Scratch of the stage before, of the pipeline that this thread runs.
_before = threading.local()


def _release_before() -> None:
    common.release(getattr(_before, "scratch", []))
    _before.scratch = []


def _stage(step):
    """Delete the scratch of the pipeline's previous stage, note this one's."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release_before()
        known = set(common.staged())
        out = step(spark, docs, sf_dir)
        _before.scratch = [x for x in common.staged() if x not in known]
        return out

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.fit_language_model(docs))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    classes = ngram_join.jaccard_classes(by_text, k=5, threshold=Fraction(8, 10))
    return common.keep_texts(docs, classes.where("doc_id = component_id").select("row_hash").distinct())


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(docs, common.table(spark, sf_dir, "benchmark"))
    go = found.where(decontam.contaminated(F.col("n_words"), F.col("n_hit"))).select("doc_id", "row_hash").distinct()
    return common.drop_rows(docs, go)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs, common.table(spark, sf_dir, "labels"))
    times = mixed.groupBy("doc_id", "row_hash").agg(F.max("copies").alias("copies")).where("copies > 0")
    return common.repeat_rows(docs, times)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(docs, n_shards=24)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages fit models, draw weighted samples and permute records; SQL cannot
#: express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = common.table(spark, sf_dir, "documents")
    root, last = ensure_checkpoint_dir(spark), None
    for name, step in STAGES:
        path = f"{root}/lendframe-pipeline-{name}-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        if last:
            common.release([(spark, last)])
        docs, last = spark.read.parquet(path), path
    _release_before()
    common.keep_until_exit(spark, last)
    return docs
