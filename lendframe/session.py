"""Session helpers.

Library functions never create a session of their own; they take the one
they are given.  ``get_session`` is for tests, the bench and command-line
use: it builds a local session with settings that also make sense on a
cluster (AQE on, no UI, UTC), and points the checkpoint folder at
``spark.checkpoint.dir`` when the cluster names one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings applied to every session we build.  On a cluster these come from
# the job configuration instead.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime broadcast: AQE converts a join to broadcast only after it has
    # measured the real size of the small side against this bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
}


def scale_settings(input_bytes: int, split_bytes: int = 256 << 20) -> dict:
    """Partition sizing for a run over ``input_bytes`` of parquet.

    Scan splits of ``split_bytes``; the shuffle starts with about one
    partition per split (each holds roughly what one scan task read, well
    within an executor's memory), and AQE then merges partitions smaller
    than the advisory size and splits skewed ones.  Apply with
    ``spark.conf.set`` before the job; all are runtime SQL settings.
    """
    n = max(200, int(input_bytes // split_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    }


def get_session(cpus: int | str = "*", app: str = "lendframe", shuffle_partitions: int = 8,
                extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LENDFRAME_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SQL_SETTINGS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the checkpoint folder already set, else the cluster's shared
    ``spark.checkpoint.dir``; only when neither exists and the master is
    local (tests) a fresh scratch folder.  A cluster without one is refused:
    each executor would write to its own disk."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's own checkpoint folder applies
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lendframe-ckpt-")
    sc.setCheckpointDir(path)
    return path
