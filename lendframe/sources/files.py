"""File sources and sinks.

* loan CSV files with a header, quoted multi-line text and the null tokens a
  default CSV reader applies (``NA`` in any column, so a country *code* "NA"
  becomes null, as it did originally);
* feature CSV files keyed by LOAN_ID;
* many prediction files in one read, the file name becoming ``model_id``;
* an image folder listed by the tasks (paths only);
* CSV / parquet writers, per-epoch outputs, metrics logs, model snapshots.

Multi-line CSV cannot be split inside a file; convert it once to parquet
(``csv_to_parquet``) and run everything else on the parquet copy.
"""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendframe.functions.fixed import KEPT_EPOCHS, NA_TOKENS

LOAN_TEXT_COLUMNS = [
    "DESCRIPTION", "DESCRIPTION_TRANSLATED", "LOAN_USE", "ORIGINAL_LANGUAGE", "SECTOR_NAME",
    "ACTIVITY_NAME", "COUNTRY_CODE", "COUNTRY_NAME", "TOWN_NAME", "CURRENCY_POLICY", "CURRENCY",
    "REPAYMENT_INTERVAL", "DISTRIBUTION_MODEL", "TAGS",
]

LOAN_COLUMNS = ["LOAN_ID", "LOAN_AMOUNT", "DESCRIPTION", "DESCRIPTION_TRANSLATED", "LOAN_USE", "IMAGE_ID",
                "ORIGINAL_LANGUAGE", "SECTOR_NAME", "ACTIVITY_NAME", "COUNTRY_CODE", "COUNTRY_NAME",
                "TOWN_NAME", "CURRENCY_POLICY", "CURRENCY_EXCHANGE_COVERAGE_RATE", "CURRENCY",
                "REPAYMENT_INTERVAL", "DISTRIBUTION_MODEL", "TAGS"]


def loan_schema(with_target: bool = True) -> T.StructType:
    """Explicit schema: every column read as text first, so that null tokens
    can be applied before numbers are parsed."""
    cols = [c for c in LOAN_COLUMNS if with_target or c != "LOAN_AMOUNT"]
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def null_tokens(c: Column, tokens=None) -> Column:
    """Null when the whole field is one of the null tokens."""
    return F.when(c.isin(*(tokens or NA_TOKENS)), F.lit(None)).otherwise(c)


def apply_null_tokens(df: DataFrame, columns=None, tokens=None) -> DataFrame:
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[null_tokens(F.col(c), tokens).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


#: Columns that are numbers, and their types.
LOAN_NUMBERS = {"LOAN_ID": "bigint", "IMAGE_ID": "bigint", "LOAN_AMOUNT": "double", "CURRENCY_EXCHANGE_COVERAGE_RATE": "double"}


def type_loans(raw: DataFrame) -> DataFrame:
    """Text loan table -> typed loan table (null tokens applied first;
    ``try_cast`` so a malformed number is null, not a failed job)."""
    df = apply_null_tokens(raw, list(raw.columns))
    return df.select(*[F.col(c).try_cast(LOAN_NUMBERS[c]).alias(c) if c in LOAN_NUMBERS else F.col(c)
                       for c in df.columns])


def read_loans_csv(spark: SparkSession, path, with_target: bool = True) -> DataFrame:
    raw = (spark.read.schema(loan_schema(with_target))
           .option("header", True).option("multiLine", True).option("escape", '"')
           .option("nullValue", None).option("emptyValue", "")
           .csv(path))
    return type_loans(raw)


#: Name of the column that holds a record the CSV reader could not split.
RECORD = "_record"


def read_loans_csv_checked(spark: SparkSession, path, with_target: bool = True, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(loans, rejects): the typed rows of a loan CSV, and the records that are not loans.

    A record is rejected when it has not as many fields as there are columns (reason ``fields``), when a
    number column holds something else (reason: the column's name), or without LOAN_ID; ``rejects``
    has (record, reasons).  Every record is in one of the two."""
    columns = [c for c in LOAN_COLUMNS if with_target or c != "LOAN_AMOUNT"]
    schema = T.StructType([*loan_schema(with_target).fields, T.StructField(RECORD, T.StringType())])
    raw = (spark.read.schema(schema).option("header", header).option("multiLine", True).option("escape", '"')
           .option("nullValue", None).option("emptyValue", "").option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", RECORD).csv(path))
    clean = apply_null_tokens(raw, columns)
    numbers = [c for c in LOAN_NUMBERS if c in columns]
    reasons = F.when(F.col(RECORD).isNotNull(), F.array(F.lit("fields"))).otherwise(F.filter(F.array(*[
        F.when(F.col(c).try_cast(LOAN_NUMBERS[c]).isNull() & (F.col(c).isNotNull() | F.lit(c == "LOAN_ID")), F.lit(c)) for c in numbers]),
        lambda r: r.isNotNull()))
    judged = clean.withColumn("reasons", reasons)
    record = F.coalesce(F.col(RECORD), F.to_csv(F.struct(*columns), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}))
    loans = judged.where(F.size("reasons") == 0).select(*[F.col(c).try_cast(LOAN_NUMBERS[c]).alias(c) if c in numbers else F.col(c) for c in columns])
    return loans, judged.where(F.size("reasons") > 0).select(record.alias("record"), "reasons")


def write_loans_csv(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Loan rows as CSV the way a pandas writer lays them out: a header,
    fields quoted when needed, quotes doubled inside quotes, nulls empty,
    and leading or trailing spaces kept (Spark's writer trims by default)."""
    write_csv(df, out, mode)


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint folder (the cluster's
    shared ``spark.checkpoint.dir``), for intermediate files a job writes and
    reads back.  Deleted when the program ends."""
    import os
    import uuid

    from lendframe.session import ensure_checkpoint_dir
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _SCRATCH.append((spark, path))
    return path


@atexit.register
def _delete_scratch() -> None:
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        sc = spark.sparkContext
        try:
            if sc._jsc is not None and not sc._jsc.sc().isStopped():
                delete_path(spark, path)
        except Exception:  # the JVM is gone already; nothing can be deleted through it
            return


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that a job wrote and has read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def csv_to_parquet(spark: SparkSession, path, out: str, with_target: bool = True) -> DataFrame:
    read_loans_csv(spark, path, with_target).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def read_feature_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """Additional per-loan features (e.g. ``LOAN_ID long, NUM_FACES int``)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_predictions(spark: SparkSession, paths) -> DataFrame:
    """Many prediction files (LOAN_ID, LOAN_AMOUNT) in one scan; the file
    name (without extension) becomes ``model_id``."""
    df = (spark.read.schema("LOAN_ID long, LOAN_AMOUNT double").option("header", True)
          .csv(list(paths)))
    return df.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.csv)?$", 1).alias("model_id"),
        "LOAN_ID", "LOAN_AMOUNT")


def write_prediction_sets(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """(model_id, LOAN_ID, LOAN_AMOUNT) as one CSV folder per model
    (``model_id=k/``).  Every task writes its own rows of each model, so no
    model is funnelled through one task."""
    df.write.mode(mode).option("header", True).partitionBy("model_id").csv(out)


def read_prediction_sets(spark: SparkSession, base: str) -> DataFrame:
    """A folder written by ``write_prediction_sets``: the model id comes
    from partition discovery."""
    return (spark.read.schema("LOAN_ID long, LOAN_AMOUNT double, model_id int").option("header", True)
            .csv(base).select("model_id", "LOAN_ID", "LOAN_AMOUNT"))


def _entries(folder: str):
    """(is a folder, path as Spark writes it) of what is in ``folder``, one at a time from a local
    disk.  Names that Spark's readers pass over are left out."""
    import os
    import re

    from pyarrow import fs
    uri = re.sub(r"^file:/+", "file:///", folder)
    system, base = fs.FileSystem.from_uri(uri)
    start = "file:" if isinstance(system, fs.LocalFileSystem) else uri[:len(uri) - len(base.lstrip("/"))].rstrip("/") + "/"
    if start == "file:":
        with os.scandir(base) as found:
            found = ((e.is_dir(), e.path) for e in found)
            yield from ((d, f"file:{p}") for d, p in found if not os.path.basename(p).startswith(("_", ".")))
        return
    for e in system.get_file_info(fs.FileSelector(base)):
        if not e.base_name.startswith(("_", ".")):
            yield e.type == fs.FileType.Directory, start + e.path.lstrip("/")


def list_image_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of every ``*.jpg`` below ``folder``; no content is read.

    The tasks list the folders; the driver only learns which folders there are, so it holds no
    list of files and plans no task for each few of them.  What only Spark's readers can open is
    listed by them."""
    import pyarrow as pa
    from pyarrow import fs
    try:
        fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return (spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg")
                .option("recursiveFileLookup", "true").load(folder).select("path"))

    def listing(folders: bool):
        def run(batches):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    held = []
                    for is_folder, entry in _entries(path):
                        if is_folder == folders and (folders or entry.endswith(".jpg")):
                            held.append(entry)
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["path"])
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["path"])
        return run

    def dealt(paths: list[str]) -> DataFrame:
        rows = spark.createDataFrame([(p,) for p in paths], "path string")
        return rows.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))

    level, known = [folder if ":" in folder else f"file:{folder}"], []
    while level:
        known += level
        level = [r.path for r in dealt(level).mapInArrow(listing(True), "path string").collect()]
    return dealt(known).mapInArrow(listing(False), "path string")


def write_csv(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """CSV with a header, quotes doubled inside quotes, nulls empty, spaces kept."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(out))


def write_epoch_outputs(df: DataFrame, out: str, epochs=None) -> None:
    """Keep the chosen epochs and write one CSV folder per epoch (``epoch=8/``).  Only the epochs
    that ``df`` holds are replaced: writing epoch 9 again leaves 8 and 10 as they are."""
    keep = epochs or KEPT_EPOCHS
    (df.where(F.col("epoch").isin(*keep)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("header", True).partitionBy("epoch").csv(out))


def read_epoch_outputs(spark: SparkSession, out: str) -> DataFrame:
    """(epoch, LOAN_ID, LOAN_AMOUNT) of a folder written by ``write_epoch_outputs``."""
    return (spark.read.schema("LOAN_ID long, LOAN_AMOUNT double, epoch int").option("header", True).csv(out)
            .select("epoch", "LOAN_ID", "LOAN_AMOUNT"))


def append_metrics(df: DataFrame, out: str, key=("run", "epoch", "step")) -> None:
    """Append rows to a metrics log (Parquet).  A row whose ``key`` (null-safe) the log has already is not written
    again, so a retried job adds nothing; of rows of ``df`` with one key, one is written.  One writer at a time."""
    spark, key = df.sparkSession, list(key)
    new = df.dropDuplicates(key)
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        held = spark.read.schema(df.schema).parquet(out).select(*[F.col(c).alias(f"_held_{c}") for c in key])
        same = [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in key]
        new = new.join(held, [c for c in same], "left_anti")
    new.write.mode("append").parquet(out)


def save_model(model, out: str) -> None:
    model.write().overwrite().save(out)


def load_pipeline_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
