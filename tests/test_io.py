"""Sources and sinks: feature CSV, image folder listing, CSV and per-epoch
outputs, metrics log, model snapshots, and the streaming form of the
stated-amount enrichment."""

import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from lendframe.functions import text as TX
from lendframe.operators import amount as A
from lendframe.operators import images as IMG
from lendframe.plans.queries import QUERIES
from lendframe.sources import files as FILES
from lendframe.sources import fixtures as fx


def test_feature_csv_roundtrip_and_left_join(spark, scratch):
    loans = fx.loan(spark, SF_SMALL)
    faces = QUERIES["detection_count"](spark, SF_SMALL)
    out = os.path.join(scratch, "num_faces")
    FILES.write_csv(faces, out)
    back = FILES.read_feature_csv(spark, out, "LOAN_ID long, NUM_FACES int")
    assert back.count() == faces.count() == loans.count()
    joined = loans.select("LOAN_ID").join(back, "LOAN_ID", "left")
    assert joined.where(F.col("NUM_FACES").isNull()).count() == 0
    assert back.exceptAll(faces).count() == 0


def test_image_folder_listing_reads_paths_only(spark, scratch):
    folder = os.path.join(scratch, "images")
    os.makedirs(os.path.join(folder, "sub"))
    for name in ("1000001.jpg", "sub/1000002.jpg", "notes.txt"):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(b"\xff\xd8\xff")
    files = FILES.list_image_files(spark, folder)
    ids = IMG.image_ids_from_files(files)
    assert sorted(r["IMAGE_ID"] for r in ids.collect()) == [1000001, 1000002]
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema:")[-1].split("\n")[0]
    loans = spark.createDataFrame([(1, 1000001), (2, 1000003)], "LOAN_ID long, IMAGE_ID long")
    pres = {r["LOAN_ID"]: r["has_image"] for r in IMG.image_presence(loans, ids).collect()}
    assert pres == {1: 1, 2: 0}


def test_file_names_and_epoch_suffix(spark):
    df = spark.createDataFrame([(7, 8)], "IMAGE_ID long, epoch int")
    r = df.select(TX.image_file_name("IMAGE_ID").alias("f"), TX.epoch_suffix("epoch").alias("e")).first()
    assert (r["f"], r["e"]) == ("7.jpg", "epoch08")


def test_epoch_outputs_keep_epochs_8_to_10_and_replace_only_what_is_written_again(spark, scratch):
    preds = fx.predictions(spark, SF_SMALL).select(
        (F.col("model_id") % 11).cast("int").alias("epoch"), "LOAN_ID", "LOAN_AMOUNT")
    out = os.path.join(scratch, "submit")
    FILES.write_epoch_outputs(preds, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("epoch=")) == ["epoch=10", "epoch=8", "epoch=9"]
    before = {e: sorted(os.listdir(os.path.join(out, f"epoch={e}"))) for e in (8, 9, 10)}
    FILES.write_epoch_outputs(preds.where("epoch = 9").limit(5), out)
    after = {e: sorted(os.listdir(os.path.join(out, f"epoch={e}"))) for e in (8, 9, 10)}
    assert after[8] == before[8] and after[10] == before[10] and after[9] != before[9]
    back = FILES.read_epoch_outputs(spark, out)
    assert back.where("epoch = 9").count() == 5 and back.where("epoch = 8").count() == preds.where("epoch = 8").count()


def test_a_retried_append_adds_nothing_to_the_metrics_log(spark, scratch):
    out = os.path.join(scratch, "metrics")
    log = lambda rows: spark.createDataFrame(rows, "run string, epoch long, step long, mae double")
    FILES.append_metrics(log([("a", 1, 10, 0.5), ("a", 1, 20, 0.4), ("a", 1, 20, 0.4)]), out)
    FILES.append_metrics(log([("a", 1, 10, 0.5), ("a", 1, 20, 0.4)]), out)
    FILES.append_metrics(log([("a", 1, 20, 9.9), ("a", 1, 30, 0.3), ("b", None, 10, 0.7)]), out)
    FILES.append_metrics(log([("b", None, 10, 0.7)]), out)
    FILES.append_metrics(log([]), out)
    assert sorted(map(repr, map(tuple, spark.read.parquet(out).collect()))) == sorted(map(repr, [
        ("a", 1, 10, 0.5), ("a", 1, 20, 0.4), ("a", 1, 30, 0.3), ("b", None, 10, 0.7)]))


def test_every_record_of_a_broken_csv_is_a_loan_or_a_reject(spark, scratch):
    lines = ["1,100.5," + "," * 15, "x2,100.5," + "," * 15, "3,abc," + "," * 15, "4,5", "5,6," + "," * 15 + ",more", "NA,7," + "," * 15,
             '8,9,"two\nlines, and a ""quote""",' + "," * 14, "9,NA," + "," * 15]
    path = os.path.join(scratch, "loans.csv")
    with open(path, "w") as f:
        f.write(",".join(FILES.LOAN_COLUMNS) + "\n" + "\n".join(lines) + "\n")
    loans, rejects = FILES.read_loans_csv_checked(spark, path)
    assert {r.LOAN_ID: r.LOAN_AMOUNT for r in loans.collect()} == {1: 100.5, 8: 9.0, 9: None}
    assert loans.where("LOAN_ID = 8").first().DESCRIPTION == 'two\nlines, and a "quote"'
    found = sorted((r.reasons, r.record.split(",")[0]) for r in rejects.collect())
    assert found == [(["LOAN_AMOUNT"], "3"), (["LOAN_ID"], ""), (["LOAN_ID"], "x2"), (["fields"], "4"), (["fields"], "5")]


def test_image_listing_of_a_query_reads_no_content(spark):
    df = QUERIES["image_files"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "binaryFile" in line.lower() or "ReadSchema" in line and "path" in line]
    assert scans and not any("content" in line for line in scans)
    assert df.where("has_image = 1").count() == fx.images(spark, SF_SMALL).count()


def test_metrics_are_observed_in_the_pass_that_writes(spark, scratch):
    from lendframe.operators import metrics as M
    rows = spark.createDataFrame([(8, 1, 10.0, 12.0), (8, 2, None, 1.0), (8, 3, 5.0, 1.0), (9, 1, 10.0, 10.0)], "epoch int, LOAN_ID long, y double, p double")
    written = []
    seen = M.observe_epochs(rows, "y", "p", [8, 9, 10], lambda df: (df.write.parquet(os.path.join(scratch, "out")), written.append(1)))
    assert [tuple(r) for r in seen.orderBy("epoch").collect()] == [(8, 2, 3.0, 1.0), (9, 1, 0.0, 0.0), (10, 0, None, None)]
    assert written == [1] and spark.read.parquet(os.path.join(scratch, "out")).count() == 4


def test_scratch_is_deleted_at_exit(spark):
    path = FILES.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.exists(local)
    held = list(FILES._SCRATCH)
    FILES._SCRATCH[:] = [h for h in held if h[1] == path]
    FILES._delete_scratch()
    FILES._SCRATCH[:] = [h for h in held if h[1] != path]
    assert not os.path.exists(local)


def test_model_snapshot_save_and_load(spark, scratch):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df = QUERIES["target_zscore"](spark, SF_SMALL).withColumn("x", F.col("LOAN_ID").cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             LinearRegression(labelCol="y_log_z", maxIter=5)]).fit(df)
    path = os.path.join(scratch, "model", "epoch08")
    FILES.save_model(model, path)
    again = FILES.load_pipeline_model(path)
    a = model.transform(df).select("LOAN_ID", "prediction")
    b = again.transform(df).select("LOAN_ID", "prediction")
    assert a.exceptAll(b).count() == 0


def test_stated_amount_stream_equals_the_batch_job(spark, scratch):
    from lendframe.streaming.enrich import start_stated_amount_job, stated_amount_stream
    loans = fx.loan(spark, SF_SMALL).select("LOAN_ID", "CURRENCY", "DESCRIPTION", "DESCRIPTION_TRANSLATED",
                                            "LOAN_AMOUNT")
    src = os.path.join(scratch, "incoming")
    # two arrivals of new loan files
    loans.where("LOAN_ID < 700").write.parquet(os.path.join(src, "a"))
    loans.where("LOAN_ID >= 700").write.parquet(os.path.join(src, "b"))
    local = A.extract_local_amount(loans, version=2, keep=["LOAN_AMOUNT"])
    rate = A.median_rate(local, min_loan_id=fx.recent_cutoff(spark, SF_SMALL))
    stream = stated_amount_stream(spark, os.path.join(src, "*"), loans.schema, rate, max_files_per_trigger=1)
    sink, ckpt = os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt")
    q = start_stated_amount_job(stream, sink, ckpt)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = A.trusted_amount(A.convert_usd(local, rate)).select("LOAN_ID", "CURRENCY", A.DESC)
    assert got.count() == loans.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stated_amount_stream_restarts_from_its_checkpoint(spark, scratch):
    """A second run with the same checkpoint picks up only the files that
    arrived since; nothing is written twice."""
    from lendframe.streaming.enrich import start_stated_amount_job, stated_amount_stream
    loans = fx.loan(spark, SF_SMALL).select("LOAN_ID", "CURRENCY", "DESCRIPTION", "DESCRIPTION_TRANSLATED",
                                            "LOAN_AMOUNT")
    src = os.path.join(scratch, "incoming")
    sink, ckpt = os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt")
    rate = A.median_rate(A.extract_local_amount(loans, version=2, keep=["LOAN_AMOUNT"]))
    loans.where("LOAN_ID < 500").write.parquet(os.path.join(src, "a"))
    start_stated_amount_job(stated_amount_stream(spark, os.path.join(src, "*"), loans.schema, rate),
                            sink, ckpt).awaitTermination(300)
    first = spark.read.parquet(sink).count()
    loans.where("LOAN_ID >= 500").write.parquet(os.path.join(src, "b"))
    start_stated_amount_job(stated_amount_stream(spark, os.path.join(src, "*"), loans.schema, rate),
                            sink, ckpt).awaitTermination(300)
    got = spark.read.parquet(sink)
    assert first == loans.where("LOAN_ID < 500").count()
    assert got.count() == loans.count() == got.select("LOAN_ID").distinct().count()


def test_loan_csv_writer_and_reader_round_trip_awkward_text(spark, scratch):
    schema = FILES.loan_schema()
    row = {c: None for c in FILES.LOAN_COLUMNS}
    row.update({"LOAN_ID": "1", "DESCRIPTION": ' two\nlines, a "quote" and a trailing space ',
                "TAGS": " #Parent", "COUNTRY_CODE": "NA", "LOAN_AMOUNT": "12.5"})
    df = spark.createDataFrame([tuple(row[c] for c in FILES.LOAN_COLUMNS)], schema)
    out = os.path.join(scratch, "loans")
    FILES.write_loans_csv(df, out)
    back = FILES.read_loans_csv(spark, out).first()
    assert back["DESCRIPTION"] == row["DESCRIPTION"] and back["TAGS"] == " #Parent"
    assert back["COUNTRY_CODE"] is None and back["LOAN_AMOUNT"] == 12.5 and back["LOAN_ID"] == 1
