"""
on the sf0.001 stand-in tables."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lendframe.functions import text as TX
from lendframe.functions.fixed import MASTER_TAGS, TRUSTED_CURRENCIES
from lendframe.operators import category as C
from lendframe.operators import ensemble as E
from lendframe.plans.queries import QUERIES
from lendframe.sources import files as FILES
from lendframe.sources import fixtures as fx


def test_denormalize_inverts_zscore(spark):
    rows = QUERIES["denormalize_roundtrip"](spark, SF_SMALL).collect()
    assert rows and all(r["exact"] == 1 for r in rows)


def test_normalize_is_idempotent_without_backslash_or_tag(spark):
    loans = fx.loan(spark, SF_SMALL)
    once = loans.select(TX.normalize_text(TX.fill_description()).alias("t"))
    once = once.where(~F.col("t").contains("\\") & ~F.col("t").contains("<"))
    bad = once.where(TX.normalize_text(F.col("t")) != F.col("t")).count()
    assert once.count() > 0 and bad == 0


def test_encoded_ids_lie_in_the_dictionary_range(spark):
    loans = fx.loan(spark, SF_SMALL)
    d = C.fit_dictionary(fx.train(loans))
    n = d.count()
    ids = C.encode_long(loans, d).agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()
    assert ids[0] >= 0 and ids[1] <= n and ids[2] == loans.count() * 10
    # test rows can carry unseen values, training rows cannot
    train_ids = C.encode_long(fx.train(loans), d).agg(F.min("id")).first()[0]
    assert train_ids >= 1


def test_tag_flags_are_zero_or_one(spark):
    df = QUERIES["tags_onehot"](spark, SF_SMALL)
    flags = [c for c in df.columns if c.startswith("tag_")]
    assert len(flags) == len(MASTER_TAGS) == 31
    bad = df.where((F.greatest(*[F.col(c) for c in flags]) > 1) | (F.least(*[F.col(c) for c in flags]) < 0))
    assert bad.count() == 0


def test_correction_only_where_a_trusted_amount_exists(spark):
    loans = fx.loan(spark, SF_SMALL)
    corrected = QUERIES["corrected_submission"](spark, SF_SMALL).alias("c")
    mean = QUERIES["ensemble_mean"](spark, SF_SMALL).alias("m")
    desc = QUERIES["convert_usd"](spark, SF_SMALL).alias("d")
    j = (corrected.join(mean, "LOAN_ID").join(desc, "LOAN_ID")
         .select("LOAN_ID", F.col("c.LOAN_AMOUNT").alias("c"), F.col("m.LOAN_AMOUNT").alias("m"),
                 "CURRENCY", "LOAN_AMOUNT_DESC"))
    untouched = j.where(F.col("LOAN_AMOUNT_DESC").isNull() | ~F.col("CURRENCY").isin(*TRUSTED_CURRENCIES))
    assert untouched.where(~F.col("c").eqNullSafe(F.col("m"))).count() == 0
    replaced = j.where(F.col("LOAN_AMOUNT_DESC").isNotNull() & F.col("CURRENCY").isin(*TRUSTED_CURRENCIES))
    assert replaced.where(F.abs(F.col("c") - F.round("LOAN_AMOUNT_DESC", 4)) > 1e-9).count() == 0
    assert replaced.count() > 0 and untouched.count() > 0
    assert corrected.count() == fx.test(loans).count()


def test_ensemble_is_invariant_under_file_order(spark, scratch):
    preds = fx.predictions(spark, SF_SMALL).toPandas()
    paths = []
    for k, part in preds.groupby("model_id"):
        p = os.path.join(scratch, f"model_{k:02d}.csv")
        part[["LOAN_ID", "LOAN_AMOUNT"]].to_csv(p, index=False)
        paths.append(p)
    a = E.ensemble_mean(FILES.read_predictions(spark, paths), n_models=len(paths))
    b = E.ensemble_mean(FILES.read_predictions(spark, list(reversed(paths))))
    ra = {r["LOAN_ID"]: round(r["LOAN_AMOUNT"], 6) for r in a.collect()}
    rb = {r["LOAN_ID"]: round(r["LOAN_AMOUNT"], 6) for r in b.collect()}
    assert ra == rb and len(ra) == preds["LOAN_ID"].nunique()
    ids = {r[0] for r in FILES.read_predictions(spark, paths).select("model_id").distinct().collect()}
    assert ids == {f"model_{k:02d}" for k in range(16)}


def test_a_loan_missing_from_one_set_has_no_mean(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 20.0), ("a", 2, 5.0), ("b", 2, None)],
                               "model_id string, LOAN_ID long, LOAN_AMOUNT double")
    got = {r["LOAN_ID"]: r["LOAN_AMOUNT"] for r in E.ensemble_mean(df).collect()}
    assert got == {1: 15.0, 2: None}


def test_holdout_is_about_a_fifth_and_stable(spark):
    a = QUERIES["holdout_split"](spark, SF_SMALL)
    share = a.agg(F.avg("is_holdout")).first()[0]
    assert 0.1 < share < 0.3
    b = QUERIES["holdout_split"](spark, SF_SMALL)
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("name", ["kernel_row_sums", "density_ratio"])
def test_shift_weights_cover_every_training_row(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    n_train = fx.shift(spark, SF_SMALL).where(~F.col("is_test")).count()
    assert df.count() == n_train


def test_density_weights_have_mean_one_per_batch(spark):
    from lendframe.operators import shift as SH
    w = SH.batch_weights(SH.assign_batches(fx.shift(spark, SF_SMALL), 128, 256))
    stats = w.groupBy("bucket", "batch").agg(F.avg("weight").alias("m"), F.max("weight").alias("mx"),
                                             F.min("weight").alias("mn"))
    assert stats.where((F.abs(F.col("m") - 1) > 1e-9) | (F.col("mn") < 0)).count() == 0


def test_wide_encoding_keeps_repeated_rows_and_equals_the_long_form(spark):
    loans = fx.loan(spark, SF_SMALL)
    d = C.fit_dictionary(fx.train(loans))
    some = loans.where("LOAN_ID <= 25").unionByName(loans.where("LOAN_ID <= 5"))
    wide = C.encode_wide(some, d, keep=["TAGS"])
    assert wide.count() == some.count() and "TAGS" in wide.columns
    long = {(r["LOAN_ID"], C.column_name(r["variable"])): r["id"] for r in C.encode_long(some, d).collect()}
    for r in wide.collect():
        assert all(r[c] == long[r["LOAN_ID"], c] for c in wide.columns if c not in ("LOAN_ID", "TAGS"))


def test_running_statistics_are_exact_on_raw_values(spark):
    import numpy as np
    from lendframe.operators import metrics as M
    for values in ([i / 1000 for i in range(1, 11)], [1e9 + i for i in range(10)], [0.123456 * i for i in range(40)]):
        log = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "epoch int, step int, mae double")
        for r in M.running_mean_std(log).collect():
            seen = np.array(values[: r["step"] + 1])
            assert abs(r["mae_mean"] - seen.mean()) <= 1e-12 * abs(seen.mean())
            assert abs(r["mae_std"] - seen.std()) <= 1e-6 * seen.std()
