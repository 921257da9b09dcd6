"""Driver parquet tables.

Each table is one parquet file ``{sf_dir}/{name}.parquet``.  Readers return
lazy DataFrames; Catalyst prunes columns and pushes filters into the scan,
so callers select only what they use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the session's checkpoint folder (the
    cluster's shared ``spark.checkpoint.dir``) and read it back.

    For a wide table that several jobs read different columns of: unlike a
    cached copy, the parquet copy is columnar, so every reader scans only
    its columns and pushes its filters into the scan; it also cuts the
    lineage, so a lost executor costs a re-read, not a recomputation.
    """
    from lendframe.sources.files import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
