"""Kernel mean matching per batch: the solution is feasible and optimal
(projected-gradient fixed point, and no feasible point tried does better)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lendframe.operators import shift as SH
from lendframe.plans.queries import QUERIES
from lendframe.sources import fixtures as fx


def _problem(seed, n_tr=40, n_te=25, dim=5, gamma=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n_tr, dim))
    t = rng.normal(loc=0.7, size=(n_te, dim))
    k_tr = np.exp(-gamma * SH._sq_dist(x, x))
    kappa = -(n_tr / n_te) * np.exp(-gamma * SH._sq_dist(x, t)).sum(axis=1)
    return k_tr, kappa


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_kmm_solution_is_feasible_and_optimal(seed):
    k_tr, kappa = _problem(seed)
    n = len(kappa)
    b = SH.kmm_solve(k_tr, kappa)
    eps = (np.sqrt(n) - 1) / np.sqrt(n)
    assert b.min() >= 0 and b.max() <= 50 + 1e-12
    assert n * (1 - eps) - 1e-6 <= b.sum() <= n * (1 + eps) + 1e-6
    p = k_tr + 1e-5 * np.eye(n)

    def f(v):
        return 0.5 * v @ p @ v + kappa @ v

    step = 1.0 / np.linalg.eigvalsh(p)[-1]
    fixed = SH._project_box_band(b - step * (p @ b + kappa), 50.0, n * (1 - eps), n * (1 + eps))
    assert np.max(np.abs(fixed - b)) < 1e-6
    rng = np.random.default_rng(seed + 10)
    for _ in range(200):  # random feasible points never beat the solution
        v = SH._project_box_band(b + rng.normal(scale=0.5, size=n), 50.0, n * (1 - eps), n * (1 + eps))
        assert f(v) >= f(b) - 1e-9


def test_projection_hits_the_band():
    v = np.array([10.0, 10.0, 10.0, -1.0])
    z = SH._project_box_band(v, 5.0, 2.0, 6.0)
    assert abs(z.sum() - 6.0) < 1e-9 and z.min() >= 0 and z.max() <= 5.0


def test_kmm_query_gives_one_feasible_weight_per_training_row(spark):
    w = QUERIES["density_ratio_kmm"](spark, SF_SMALL)
    n_train = fx.shift(spark, SF_SMALL).where(~F.col("is_test")).count()
    stats = w.agg(F.count(F.lit(1)), F.min("weight"), F.max("weight")).first()
    assert stats[0] == n_train and stats[1] >= 0 and stats[2] <= 50


def test_weighted_regression_honours_the_weights(spark):
    from lendframe.plans import queries as Q
    batched = SH.assign_batches(fx.shift(spark, SF_SMALL), 128, 256)
    w = SH.batch_weights(batched, method="kmm")
    ones = w.withColumn("weight", F.lit(1.0))
    doubled = w.withColumn("weight", F.lit(2.0))
    a = SH.fit_weighted_regression(batched, ones).coefficients.toArray()
    b = SH.fit_weighted_regression(batched, doubled).coefficients.toArray()
    assert np.max(np.abs(a - b)) < 1e-6          # a constant factor changes nothing
    out = Q.QUERIES["weighted_regression"](spark, SF_SMALL)
    n_test = fx.shift(spark, SF_SMALL).where(F.col("is_test")).count()
    assert out.count() == n_test and out.where(F.col("prediction").isNull()).count() == 0


def _sides(spark, n_train, n_test):
    rows = spark.range(n_train + n_test).select(
        F.col("id").alias("vec_id"), (F.col("id") >= n_train).alias("is_test"),
        F.array((F.col("id") % 17 / 17.0), (F.col("id") % 5 / 5.0)).alias("x"), F.lit(1.0).alias("y"))
    return SH.assign_batches(rows, 16, 64)


def test_every_training_row_meets_test_rows_when_those_are_few(spark):
    weights = SH.batch_weights(_sides(spark, 1000, 3)).toPandas()
    size = weights.groupby(["bucket", "batch"])["vec_id"].transform("size")
    assert len(weights) == 1000
    assert (weights["kappa"].isna() == (size == 1)).all()  # one row has no kernel width


def test_every_test_row_is_met_when_those_are_many(spark):
    batched = _sides(spark, 40, 1000)
    pairs = SH._batch_pairs(batched)
    train, test = SH._blocks(batched, False), SH._blocks(batched, True, "test_")
    met = pairs.join(train, ["bucket", "batch"]).join(test, ["test_bucket", "test_batch"])
    assert met.select(F.explode("test_rows.vec_id")).distinct().count() == 1000
    assert met.select(F.explode("rows.vec_id")).distinct().count() == 40
    assert SH.batch_weights(batched).where("kappa is null").count() == 0


def test_sums_over_several_test_batches_equal_brute_force(spark):
    batched = _sides(spark, 12, 200)  # one training batch, every test row
    rows = batched.toPandas()
    x = np.stack(rows[~rows.is_test].sort_values("vec_id")["x"].to_numpy())
    t = np.stack(rows[rows.is_test]["x"].to_numpy())
    gamma = np.quantile([np.linalg.norm(a - b) for i, a in enumerate(x) for b in x[i + 1:]], 0.01)
    want = [-12 / 200 * sum(np.exp(-gamma * np.sum((a - b) ** 2)) for b in t) for a in x]
    got = SH.batch_weights(batched).toPandas().sort_values("vec_id")["kappa"]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_pair_products_run_without_python_and_without_pair_rows(spark):
    batched = _sides(spark, 300, 300)
    for df in (SH.kernel_sums(batched), SH.kernel_width(batched), SH.batch_weights(batched)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_another_epoch_deals_other_batches(spark):
    rows = fx.shift(spark, SF_SMALL)
    a, b = (SH.assign_batches(rows, 8, 16, epoch=e).select("vec_id", "bucket").collect() for e in (0, 1))
    assert len(a) == len(b) and {tuple(r) for r in a} != {tuple(r) for r in b}
