"""Stand-in tables over the driver parquet data.

The original work reads loan CSV files that are not available.  These views
build tables with the same columns and the same awkward cases (null text,
escaped control sequences, HTML, tags with ``#`` and spaces, amounts written
with thousands separators or decimals, a currency outside the trusted list)
from the TPC-H-like driver tables, so every operator is exercised on data
that grows with the scale factor.

They are written with the DataFrame API; the equivalent SQL (used by the
DuckDB oracle) lives in ``lendframe.plans.oracle``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.sources.tables import read_table

BS = "\\"


def recent_cutoff(spark: SparkSession, sf_dir: str) -> Column:
    """Stand-in for the original recency bound: a third of the largest loan
    id, as a scalar subquery over the data."""
    return read_table(spark, sf_dir, "orders").select(F.floor(F.max("o_orderkey") / 3)).scalar()


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for key, value in mapping.items():
        expr = (F.when(col == F.lit(key), F.lit(value)) if expr is None
                else expr.when(col == F.lit(key), F.lit(value)))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def _bigint_text(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def loan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``loan`` view: train and test after their union
    (``LOAN_AMOUNT`` null for the test fifth)."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    # One shuffle join (orders x customer); nation and region are tiny
    # dimension tables that the planner broadcasts by their measured size.
    base = (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey))

    nk5 = F.col("n_nationkey") % 5
    multiplier = _case(nk5, {0: 50, 1: 110, 2: 360, 3: 1}, 55)
    q = F.floor(F.col("o_totalprice") * multiplier).cast("bigint")
    currency = _case(nk5, {0: "PHP", 1: "KES", 2: "UGX", 3: "USD"}, "XOF")
    tag1 = _case(F.col("c_mktsegment"), {
        "HOUSEHOLD": "Parent", "MACHINERY": "Technology", "FURNITURE": "Repair Renew Replace",
        "BUILDING": "Biz Durable Asset"}, "Eco-friendly")
    okey = F.col("o_orderkey")

    b = base.select(
        okey.alias("LOAN_ID"),
        F.col("o_totalprice").alias("AMT"),
        F.col("c_mktsegment").alias("SECTOR_NAME"),
        F.col("o_orderpriority").alias("ACTIVITY_NAME"),
        F.col("r_name").alias("COUNTRY_CODE"),
        F.when(F.col("n_nationkey") % 7 == 6, F.lit(None).cast("string"))
         .otherwise(F.col("n_name")).alias("COUNTRY_NAME"),
        F.col("c_name").alias("TOWN_NAME"),
        _case(F.col("o_orderstatus"), {"O": "shared", "F": "not shared"}).alias("CURRENCY_POLICY"),
        _case(F.col("o_orderstatus"), {"O": 0.1, "F": 0.0}).cast("double")
         .alias("CURRENCY_EXCHANGE_COVERAGE_RATE"),
        currency.alias("CURRENCY"),
        _case(okey % 3, {0: "English", 1: "Spanish"}, "French").alias("ORIGINAL_LANGUAGE"),
        _case(okey % 3, {0: "monthly", 1: "bullet"}, "irregular").alias("REPAYMENT_INTERVAL"),
        F.when(okey % 10 == 0, "direct").otherwise("field_partner").alias("DISTRIBUTION_MODEL"),
        tag1.alias("TAG1"),
        q.alias("q"),
    )
    qc = F.when(
        F.col("q") >= 1000000,
        F.concat(_bigint_text(F.floor(F.col("q") / 1000000)), F.lit(","),
                 F.lpad((F.floor(F.col("q") / 1000).cast("bigint") % 1000).cast("string"), 3, "0"),
                 F.lit(","), F.lpad((F.col("q") % 1000).cast("string"), 3, "0")),
    ).otherwise(
        F.concat(_bigint_text(F.floor(F.col("q") / 1000)), F.lit(","),
                 F.lpad((F.col("q") % 1000).cast("string"), 3, "0")))
    b = b.withColumn("QS", F.col("q").cast("string")).withColumn("QC", qc).drop("q")

    lid = F.col("LOAN_ID")
    cur = F.col("CURRENCY")
    null_text = F.lit(None).cast("string")
    b = b.select(
        "*",
        F.when(lid % 5 < 4, F.col("AMT")).alias("LOAN_AMOUNT"),
        F.when(lid % 11 == 0, null_text)
         .when(lid % 2 == 0, F.concat(F.lit("#"), F.col("TAG1"), F.lit(", user_favorite, #"), F.col("TAG1")))
         .otherwise(F.concat(F.lit(" #Repeat Borrower,#"), F.col("TAG1"), F.lit(",not in master")))
         .alias("TAGS"),
        F.when(lid % 4 == 0, null_text)
         .when(lid % 4 == 1, F.concat(F.lit("<b>Hello</b>  we are 12 people. She asks for "), cur,
                                       F.lit(" "), F.col("QC"), F.lit(" to buy stock. Thanks")))
         .when(lid % 4 == 2, F.concat(F.lit("Needs "), F.col("QS"), F.lit(" "), cur,
                                       F.lit(".<br />She repays in 24 months. Last loan was "), cur,
                                       F.lit(" 100.50 only")))
         .otherwise(F.lit("No amount is stated here. Only words")).alias("DESCRIPTION_TRANSLATED"),
        F.concat(F.lit("Pide "), cur, F.col("QS")).alias("DESCRIPTION"),
    )
    loan_use = F.concat(
        F.lit(" To buy" + BS + "n" + BS + "u200b stock" + chr(160) + chr(9) + chr(28) + "for <i>"),
        F.col("TAG1"),
        F.lit("</i>it" + BS + "'s  " + BS + BS + "shop" + BS + "xad. ÉTÉ "))
    return b.select(
        "*",
        (lid + 1000000).alias("IMAGE_ID"),
        F.when(lid % 13 == 0, null_text).otherwise(loan_use).alias("LOAN_USE"),
    )


# Columns of the loan view that only build other columns (FIXTURES.md).
HELPER_COLUMNS = ["AMT", "TAG1", "QS", "QC"]


def train(loans: DataFrame) -> DataFrame:
    return loans.where(F.col("LOAN_AMOUNT").isNotNull())


def test(loans: DataFrame) -> DataFrame:
    return loans.where(F.col("LOAN_AMOUNT").isNull()).drop("LOAN_AMOUNT")


N_MODELS = 16


def predictions(spark: SparkSession, sf_dir: str, loans: DataFrame | None = None,
                n_models: int = N_MODELS) -> DataFrame:
    """Sixteen prediction sets (``model_id`` int 0..15), every loan once per model.

    Generated per loan with ``explode`` (no join): each loan row fans out to
    its ``n_models`` predictions in the same task.
    """
    loans = loans if loans is not None else loan(spark, sf_dir)
    return (loans.select("LOAN_ID", "AMT",
                         F.explode(F.sequence(F.lit(0), F.lit(n_models - 1)))
                         .alias("model_id"))
            # SQL literals are exact decimals, as in the SQL definition.
            .select("model_id", "LOAN_ID",
                    F.expr("AMT * (0.8 + 0.02 * model_id + 0.01 * (LOAN_ID % 7))").alias("LOAN_AMOUNT")))


def metrics_log_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training-log rows before step numbering: (epoch, event_id, mae)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return ev.select((F.col("user_id") % 5).alias("epoch"), "event_id", F.col("value").alias("mae"))


def images(spark: SparkSession, sf_dir: str, loans: DataFrame | None = None) -> DataFrame:
    """Image files that exist: (IMAGE_ID, path)."""
    loans = loans if loans is not None else loan(spark, sf_dir)
    return (loans.where(F.col("LOAN_ID") % 6 != 0)
            .select("IMAGE_ID", F.concat(F.lit("data/images/"), F.col("IMAGE_ID").cast("string"),
                                         F.lit(".jpg")).alias("path")))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per detected box: (IMAGE_ID, box_id)."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return li.select((F.col("l_orderkey") + 1000000).alias("IMAGE_ID"),
                     F.col("l_linenumber").alias("box_id"))


def shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariate-shift input: (vec_id, is_test, x array<double>, y)."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", (F.col("vec_id") % 5 == 4).alias("is_test"),
                      F.col("embedding").cast("array<double>").alias("x"),
                      F.col("label").cast("double").alias("y"))


def _open_folder(folder: str):
    """The file system of a folder and the folder's path in it (also called in tasks)."""
    from pyarrow import fs
    system, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if folder.startswith("file:") else folder)
    system.create_dir(base, recursive=True)
    return system, base


#: Images of one sub-folder, and names of one file on disk (ext4 allows 65000).
IMAGES_PER_FOLDER = 10_000
LINKS_PER_FILE = 10_000
IMAGE_BYTES = b"\xff\xd8\xff\xd9"


def write_image_files(images: DataFrame, folder: str) -> int:
    """Stand-in image folder: a small file ``{IMAGE_ID // 10000}/{IMAGE_ID}.jpg`` for every row,
    written by the tasks.  Returns how many.

    The stand-ins are all alike.  On a local disk, where each file takes a block and an inode of
    its own, they are names (hard links) of a few files; elsewhere each is a file."""
    def write(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        system, base = _open_folder(folder)
        local, made, seed, names = isinstance(system, fs.LocalFileSystem), set(), None, 0
        for batch in batches:
            for image_id in batch.column(0).to_pylist():
                home = f"{base}/{(image_id or 0) // IMAGES_PER_FOLDER}"
                if home not in made:
                    system.create_dir(home, recursive=True)
                    made.add(home)
                path = f"{home}/{image_id}.jpg"
                if not local:
                    with system.open_output_stream(path) as out:
                        out.write(IMAGE_BYTES)
                    continue
                if seed is None or names == LINKS_PER_FILE:
                    if seed is not None:
                        os.unlink(seed)
                    seed, names = f"{base}/.{uuid.uuid4().hex}", 0
                    with open(seed, "wb") as out:
                        out.write(IMAGE_BYTES)
                try:
                    os.link(seed, path)
                    names += 1
                except FileExistsError:  # the same image again, or a task that runs again
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
        if seed is not None:
            os.unlink(seed)

    return images.select("IMAGE_ID").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_prediction_files(predictions: DataFrame, folder: str) -> list[str]:
    """Stand-in prediction files as the original names them: one CSV file a model, ``model_07.csv``.
    Returns their paths.

    A model's rows go to one task, which writes them batch by batch: it holds no model whole,
    and one open file for each of its models."""
    def write(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import csv
        system, base = _open_folder(folder)
        files = {}
        for batch in batches:
            models = batch.column(0)
            for model in pc.unique(models).to_pylist():
                rows = batch.filter(pc.equal(models, model)).select(["LOAN_ID", "LOAN_AMOUNT"])
                if model not in files:
                    out = system.open_output_stream(f"{base}/model_{model:02d}.csv")
                    files[model] = out, csv.CSVWriter(out, rows.schema)
                files[model][1].write_batch(rows)
        for out, writer in files.values():
            writer.close()
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"model_{m:02d}.csv" for m in files], pa.string())], names=["name"])

    rows = predictions.select("model_id", "LOAN_ID", F.col("LOAN_AMOUNT").cast("double").alias("LOAN_AMOUNT"))
    tasks = int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.repartition(tasks, "model_id").mapInArrow(write, "name string").collect()  # one row a model
    return [f"{folder}/{r.name}" for r in sorted(names)]


def loan_csv_lines(loans: DataFrame, columns) -> DataFrame:
    """Stand-in loan CSV records (one text column, no header), some of them broken: a field
    too many, a LOAN_ID or an amount that is no number, a record cut short."""
    line = F.to_csv(F.struct(*columns), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    lid = F.col("LOAN_ID")
    bad_id = F.to_csv(F.struct(*[F.concat(F.lit("x"), lid.cast("string")).alias(c) if c == "LOAN_ID" else F.col(c) for c in columns]), {"escape": '"'})
    bad_amount = F.to_csv(F.struct(*[F.lit("abc").alias(c) if c == "LOAN_AMOUNT" else F.col(c) for c in columns]), {"escape": '"'})
    return loans.select(
        F.when(lid % 17 == 0, F.concat(line, F.lit(",one more"))).when(lid % 19 == 0, bad_id).when(lid % 23 == 0, bad_amount)
        .when(lid % 29 == 0, F.concat(lid.cast("string"), F.lit(",cut"))).otherwise(line).alias("value"))
