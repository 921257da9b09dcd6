"""Steps that must not grow with one key, one model, one file or one vector."""

import glob
import os

from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lendframe.operators import amount as A
from lendframe.operators import category as C
from lendframe.operators import images as IMG
from lendframe.operators import model as MD
from lendframe.sources import files as FILES
from lendframe.sources import fixtures as fx


def test_vector_size_spreads_nothing_out(spark):
    df = spark.createDataFrame([(Vectors.sparse(2_000_000_000, [5], [1.0]),), (Vectors.dense([1.0, 2.0, 3.0]),)], ["v"])
    assert sorted(r[0] for r in df.select(MD.vector_size("v")).collect()) == [3, 2_000_000_000]


def test_regressor_reads_written_vectors_without_slot_names(spark, monkeypatch):
    seen = []

    class Recorder:
        def fit(self, rows):
            seen.append(rows)
            return MD.HashingTF(inputCol="x", outputCol="y")

    def rows(n):
        base = spark.range(n).withColumn("cat", F.col("id") % 7)
        base = base.select("cat", (F.exp(F.col("id") % 5)).alias("LOAN_AMOUNT"), F.lit(1.0).alias("n"),
                           *[F.split(F.lit("a b c"), " ").alias(f"words_{t}") for t in MD.TEXT_FIELDS])
        return base.withColumns({MD.TAGS.flag_name(t): F.lit(0) for t in MD.MASTER_TAGS})

    monkeypatch.setattr(MD, "_regressor", lambda kind: Recorder())
    MD.fit_regressor(rows(50), ["cat"], ["n"], text_dim=16)
    assert seen[0].schema["features"].metadata == {} and seen[0].count() == 50
    assert seen[0].inputFiles()


def test_linear_fits_of_the_grid_read_written_vectors_without_slot_names(spark, monkeypatch):
    from pyspark.ml.feature import SQLTransformer
    seen = {}

    class Recorder:
        def __init__(self, kind):
            self.kind = kind

        def setParams(self, **params):
            self.params = params
            return self

        def fit(self, rows):
            seen[self.kind] = (rows, self.params)
            return SQLTransformer(statement="SELECT *, 0.5 AS prediction FROM __THIS__")

    variants = {"all": (MD.TEN, True, ("faces",), "linear", {"regParam": 0.5}), "trees": (MD.NINE, False, ("stated",), "gbt", {"maxIter": 2})}
    columns = sorted({c for v in variants.values() for c in MD.variant_columns(v)})
    rows = spark.range(40).select(F.col("id").alias("LOAN_ID"), F.exp(F.col("id") % 5).alias("LOAN_AMOUNT"), *[F.lit(1.0).alias(c) for c in columns])
    monkeypatch.setattr(MD, "_regressor", Recorder)
    got = MD.evaluate_grid(rows.where("LOAN_ID < 30"), rows.where("LOAN_ID >= 30"), rows, variants).collect()
    assert sorted(r.variant for r in got) == ["all", "constant", "trees"]
    linear, params = seen["linear"]
    assert params == {"regParam": 0.5} and linear.count() == 30 and linear.columns == ["features", "y_log_z"]
    assert linear.schema["features"].metadata == {} and all("grid-vectors" in f for f in linear.inputFiles())
    trees, params = seen["gbt"]  # these need to know which slots are flags
    assert params == {"maxIter": 2} and trees.count() == 30 and trees.schema["features"].metadata


def test_images_share_their_blocks_and_no_file_is_listed_by_the_driver(spark, scratch):
    ids = spark.range(995, 25_005).select(F.col("id").alias("IMAGE_ID")).unionByName(spark.range(1000, 1003).select(F.col("id").alias("IMAGE_ID")))
    folder = os.path.join(scratch, "images")
    assert fx.write_image_files(ids.repartition(4), folder) == 24_013
    names = glob.glob(os.path.join(folder, "**", "*.jpg"), recursive=True)
    assert len(names) == 24_010 and len({os.stat(n).st_ino for n in names}) <= 24
    assert all(os.path.getsize(n) == 4 for n in names[:50])
    assert [n for n in os.listdir(folder) if n.startswith(".")] == []
    files = FILES.list_image_files(spark, folder)
    assert "binaryFile" not in files._jdf.queryExecution().toString()
    assert {os.path.dirname(r.path) for r in files.collect()} == {f"file:{folder}/{i}" for i in (0, 1, 2)}
    found = IMG.image_ids_from_files(files)
    assert sorted(r.IMAGE_ID for r in found.collect()) == list(range(995, 25_005))


def test_prediction_files_are_written_batch_by_batch(spark, scratch, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    def whole(*_):
        raise AssertionError("a model's predictions in one piece")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", whole)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        preds = spark.range(300).select((F.col("id") % 3).cast("int").alias("model_id"), F.col("id").alias("LOAN_ID"), (F.col("id") * 0.5).alias("LOAN_AMOUNT"))
        paths = fx.write_prediction_files(preds, os.path.join(scratch, "named"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [os.path.basename(p) for p in paths] == ["model_00.csv", "model_01.csv", "model_02.csv"]
    back = FILES.read_predictions(spark, paths).collect()
    assert sorted((r.LOAN_ID, r.model_id, r.LOAN_AMOUNT) for r in back) == [(i, f"model_{i % 3:02d}", i * 0.5) for i in range(300)]


def test_sketch_store_has_no_folder_for_each_part(spark, scratch):
    base = spark.range(30_000).select(F.col("id").alias("LOAN_ID"), F.lit("PHP").alias("CURRENCY"), (F.col("id") % 100).cast("double").alias("rate"))
    path = os.path.join(scratch, "sketches")
    for rows in (base.where("LOAN_ID < 15000"), base.where("LOAN_ID >= 15000")):
        A.write_rate_sketches(A.rate_sketches(rows, 500), path)
    files = glob.glob(os.path.join(path, "**", "*.parquet"), recursive=True)
    assert 0 < len(files) <= 16 and not glob.glob(os.path.join(path, "part=*"))
    store = spark.read.parquet(path)
    assert store.count() == 60  # each part is one sketch
    assert A.sketched_median_rate(store).first().n == 30_000
    assert A.sketched_median_rate(store, min_part=30).first().n == 15_000


def test_a_value_of_most_rows_is_no_hot_task(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    loans = spark.range(16_000).select(F.col("id").alias("LOAN_ID"), F.when(F.col("id") % 10 > 0, "most").when(F.col("id") % 20 == 0, F.concat(
        F.lit("v"), F.col("id").cast("string"))).alias("SECTOR_NAME"), F.lit("unseen").alias("ACTIVITY_NAME"))
    variables = ["SECTOR_NAME", "ACTIVITY_NAME"]
    dictionary = C.fit_dictionary(loans.where("LOAN_ID < 12000"), ["SECTOR_NAME"])
    try:
        for n, v in zip(names, ("-1", "false")):
            spark.conf.set(n, v)
        encoded = C.encode_long(loans, dictionary, variables)
        per_task = [r["count"] for r in encoded.groupBy(F.spark_partition_id()).count().collect()]
        got = {(r.LOAN_ID, r.variable): r.id for r in encoded.collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert max(per_task) < 32_000 / 4
    ids = {r.value: r.id for r in dictionary.collect()}
    want = {(i, "SECTOR_NAME"): ids.get("most" if i % 10 else f"v{i}" if i % 20 == 0 else None, 0) for i in range(16_000)}
    assert got == {**want, **{(i, "ACTIVITY_NAME"): 0 for i in range(16_000)}}
