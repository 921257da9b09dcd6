"""Covariate-shift weights computed in bounded batches.

The original pairs each training mini-batch (128 rows) with a test
mini-batch and, inside that pair only, computes
  * a kernel parameter: the 0.01 quantile of the pairwise distances between
    the training rows of the batch (passed on unchanged as the RBF gamma);
  * kernel sums  kappa_i = -(n_tr / n_te) * sum_j exp(-gamma * |x_i - t_j|^2);
  * importance weights for the loss.
The original solves a quadratic program for the weights (kernel mean
matching); ``batch_weights(method="kmm")`` solves the same program per batch
with NumPy.  The default is the closed-form kernel density ratio
  w_i = mean_j K(x_i, t_j) / mean_k K(x_i, x_k),
clipped to [0, 50] and rescaled to mean 1 within the batch, which SQL can
express (it has an oracle); it approximates the same matching objective.

Batches are formed without any global ordering: the rows of each side are
hashed into that side's buckets, of about ``rows_per_bucket`` rows (the bucket
counts are scalar subqueries over the data), numbered inside their bucket, and
cut into batches of ``batch_size``.  Buckets of the two sides are paired by
their number, the longer row of buckets repeating the shorter, and so are the
batches inside a pair of buckets: every training batch meets at least one test
batch, and every test batch a training batch.  A batch is one row that holds its
vectors as an array (at most ``batch_size``); two batches that meet are one row
with both arrays, and distances, the quantile and the kernel sums are array
functions of that row.  No pair of vectors is ever a row, and no Python runs (the
quadratic program alone is solved in NumPy, per batch).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendframe.functions.fixed import KERNEL_DISTANCE_QUANTILE, WEIGHT_UPPER_BOUND
from lendframe.functions.vectors import euclidean, quantile, rbf

BATCH_SIZE = 128
ROWS_PER_BUCKET = 8192


def _bucket_count(shift: DataFrame, is_test: bool, rows_per_bucket: int):
    """Rounded down, so that a hashed bucket is not left without rows."""
    rows = shift.select(F.count_if(F.col("is_test") == is_test)).scalar()
    return F.greatest(F.lit(1), F.floor(rows / F.lit(rows_per_bucket))).cast("bigint")


def assign_batches(shift: DataFrame, batch_size: int = BATCH_SIZE,
                   rows_per_bucket: int = ROWS_PER_BUCKET, epoch: int = 0) -> DataFrame:
    """Add ``bucket`` and ``batch`` to (vec_id, is_test, x, y).  Another
    ``epoch`` deals the rows to other buckets, so batches differ between epochs."""
    n_buckets = F.when(F.col("is_test"), _bucket_count(shift, True, rows_per_bucket)).otherwise(
        _bucket_count(shift, False, rows_per_bucket))
    with_bucket = shift.withColumn("bucket", F.pmod(
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{epoch}-"), F.col("vec_id").cast("string"))), 1, 8), 16, 10)
        .cast("bigint"), n_buckets))
    w = Window.partitionBy("is_test", "bucket").orderBy("vec_id")
    return with_bucket.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch_size).cast("bigint"))


def _blocks(batched: DataFrame, is_test: bool, prefix: str = "") -> DataFrame:
    """One row per batch: {prefix}bucket, {prefix}batch, {prefix}rows (its vec_id and
    x, by vec_id)."""
    own = batched.where(F.col("is_test") == F.lit(is_test))
    return own.groupBy(F.col("bucket").alias(f"{prefix}bucket"), F.col("batch").alias(f"{prefix}batch")).agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias(f"{prefix}rows"))


def _batch_pairs(batched: DataFrame) -> DataFrame:
    """The batches that meet: bucket, batch, test_bucket, test_batch."""
    sizes = batched.groupBy("is_test", "bucket").agg((F.max("batch") + 1).alias("n"))
    sides = [sizes.where(F.col("is_test") == t).select(F.col("bucket").alias(f"{p}bucket"), F.col("n").alias(f"_{p}n"))
             for t, p in ((False, ""), (True, "test_"))]
    counts = [sizes.where(F.col("is_test") == t).select(F.max("bucket") + 1).scalar() for t in (False, True)]
    return (sizes.select(F.col("bucket").alias("_g")).distinct()
            .select(F.pmod("_g", counts[0]).alias("bucket"), F.pmod("_g", counts[1]).alias("test_bucket"))
            .join(sides[0], "bucket").join(sides[1], "test_bucket")
            .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest("_n", "_test_n") - 1)))
            .select("bucket", F.pmod("_i", "_n").alias("batch"), "test_bucket", F.pmod("_i", "_test_n").alias("test_batch")))


def _with_width(blocks: DataFrame, q: float) -> DataFrame:
    """Add kernel_width: the quantile of the distances of the block's vectors, null for one vector."""
    apart = F.flatten(F.transform("rows", lambda r, i: F.transform(
        F.slice("rows", i + 2, F.size("rows")), lambda other: euclidean(r["x"], other["x"]))))
    return blocks.withColumn("_d", F.sort_array(apart)).withColumn("kernel_width", quantile(F.col("_d"), q)).drop("_d")


def kernel_width(batched: DataFrame, q: float = KERNEL_DISTANCE_QUANTILE) -> DataFrame:
    """(bucket, batch, kernel_width) per training batch."""
    return _with_width(_blocks(batched, False), q).select("bucket", "batch", "kernel_width")


def kernel_sums(batched: DataFrame, q: float = KERNEL_DISTANCE_QUANTILE) -> DataFrame:
    """(vec_id, bucket, batch, k_sum, n_te): the kernel of each training row with all
    test rows its batch meets, added up; n_te is their number."""
    train, test = _with_width(_blocks(batched, False).where(F.size("rows") > 1), q), _blocks(batched, True, "test_")
    met = _batch_pairs(batched).join(train, ["bucket", "batch"]).join(test, ["test_bucket", "test_batch"])
    each = F.explode(F.transform("rows", lambda r: F.struct(r["vec_id"].alias("vec_id"), F.aggregate(
        "test_rows", F.lit(0.0), lambda total, t: total + rbf(r["x"], t["x"], F.col("kernel_width"))).alias("k"))))
    return (met.select("bucket", "batch", F.size("test_rows").alias("n"), each.alias("r"))
            .groupBy(F.col("r.vec_id").alias("vec_id"), "bucket", "batch").agg(F.sum("r.k").alias("k_sum"), F.sum("n").alias("n_te")))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    if len(pdf) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in pdf["x"].to_numpy()])


def _sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    diff = a[:, None, :] - b[None, :, :]
    return np.sum(diff * diff, axis=2)


def _project_box_band(v: np.ndarray, upper: float, lo: float, hi: float) -> np.ndarray:
    """Euclidean projection onto {0 <= b <= upper, lo <= sum(b) <= hi}: clip
    v - lam, with lam = 0 if the clipped sum is inside the band, else found
    by bisection (the clipped sum falls as lam grows)."""
    z = np.clip(v, 0.0, upper)
    s = z.sum()
    if lo <= s <= hi:
        return z
    target = hi if s > hi else lo
    a, b = float(v.min()) - upper, float(v.max())
    for _ in range(200):
        m = 0.5 * (a + b)
        if np.clip(v - m, 0.0, upper).sum() > target:
            a = m
        else:
            b = m
    return np.clip(v - 0.5 * (a + b), 0.0, upper)


def kmm_solve(k_tr: np.ndarray, kappa: np.ndarray, upper: float = WEIGHT_UPPER_BOUND,
              ridge: float = 1e-5, max_iter: int = 50000, tol: float = 1e-12) -> np.ndarray:
    """Kernel mean matching weights of one batch: the minimiser of
    1/2 b'(K + ridge I)b + kappa'b  subject to  0 <= b <= upper  and
    |sum(b) - n| <= n (sqrt(n) - 1) / sqrt(n).

    Accelerated projected gradient with restarts; the problem is strongly
    convex (ridge > 0), so the minimiser is unique.
    """
    n = len(kappa)
    p = k_tr + ridge * np.eye(n)
    eps = (np.sqrt(n) - 1.0) / np.sqrt(n)
    lo, hi = n * (1.0 - eps), n * (1.0 + eps)
    step = 1.0 / float(np.linalg.eigvalsh(p)[-1])
    beta = _project_box_band(np.ones(n), upper, lo, hi)
    y, t = beta.copy(), 1.0
    for _ in range(max_iter):
        nxt = _project_box_band(y - step * (p @ y + kappa), upper, lo, hi)
        if np.max(np.abs(nxt - beta)) <= tol * max(1.0, np.max(np.abs(nxt))):
            return nxt
        if np.dot(y - nxt, nxt - beta) > 0:  # momentum points uphill: restart
            t = 1.0
        t_next = 0.5 * (1.0 + np.sqrt(1.0 + 4.0 * t * t))
        y = nxt + ((t - 1.0) / t_next) * (nxt - beta)
        beta, t = nxt, t_next
    raise RuntimeError(f"matching weights not converged after {max_iter} steps")


def batch_weights(batched: DataFrame, q: float = KERNEL_DISTANCE_QUANTILE,
                  upper: float = WEIGHT_UPPER_BOUND, method: str = "ratio") -> DataFrame:
    """Per training row: (vec_id, bucket, batch, kernel_width, kappa, weight).

    ``method="ratio"``: the closed-form kernel density ratio, clipped and
    rescaled to mean 1.  ``method="kmm"``: the kernel-mean-matching
    quadratic program of the original, solved per batch (``kmm_solve``).
    Without any test row, and for a training batch of one row (it has no
    kernel width), kappa is null and the weight 1.
    """
    if method == "kmm":
        return _matching_weights(batched, q, upper)
    blocks = _with_width(_blocks(batched, False), q)
    own = blocks.select("bucket", "batch", "kernel_width", F.size("rows").alias("n_tr"), F.explode(F.transform("rows", lambda r: F.struct(
        r["vec_id"].alias("vec_id"),
        F.when(F.col("kernel_width").isNotNull(), F.aggregate(
            "rows", F.lit(0.0), lambda total, o: total + rbf(r["x"], o["x"], F.col("kernel_width")))).alias("k")))).alias("r"))
    rows = own.select(F.col("r.vec_id").alias("vec_id"), "bucket", "batch", "kernel_width", "n_tr", (F.col("r.k") / F.col("n_tr")).alias("mean_tr"))
    met = kernel_sums(batched, q)
    rows = rows.join(met, ["vec_id", "bucket", "batch"], "left").withColumn("mean_te", F.col("k_sum") / F.col("n_te"))
    # a batch has at most ``batch_size`` rows
    in_batch = Window.partitionBy("bucket", "batch")
    ratio = F.least(F.greatest(F.col("mean_te") / F.col("mean_tr"), F.lit(0.0)), F.lit(float(upper)))
    rows = rows.withColumn("_q", ratio).withColumns({"_total": F.sum("_q").over(in_batch), "_known": F.count("_q").over(in_batch)})
    weighted = (F.col("_known") == F.col("n_tr")) & (F.col("_total") > 0)
    return rows.select(
        "vec_id", "bucket", "batch", "kernel_width", F.when(F.col("_known") == F.col("n_tr"), -F.col("n_tr") * F.col("mean_te")).alias("kappa"),
        F.when(weighted, F.col("_q") * F.col("n_tr") / F.col("_total")).otherwise(F.lit(1.0)).alias("weight"))


def _matching_weights(batched: DataFrame, q: float, upper: float) -> DataFrame:
    """The weights by quadratic program: kernel sums as above, one program per batch in NumPy."""

    def weigh(key, tr, met):
        rows = tr.sort_values("vec_id").merge(met[["vec_id", "k_sum", "n_te", "kernel_width"]], on="vec_id", how="left")
        n_tr = len(rows)
        x = _matrix(rows)
        gamma = rows["kernel_width"].iloc[0] if n_tr else None
        kappa, weight = np.full(n_tr, np.nan), np.ones(n_tr)
        if n_tr and rows["n_te"].notna().all():
            kappa = -float(n_tr) * rows["k_sum"].to_numpy() / rows["n_te"].to_numpy()
            weight = kmm_solve(np.exp(-gamma * _sq_dist(x, x)), kappa, upper)
        return pd.DataFrame({
            "vec_id": rows["vec_id"].to_numpy(), "bucket": key[0], "batch": key[1],
            "kernel_width": gamma, "kappa": kappa, "weight": weight})

    met = kernel_sums(batched, q).join(kernel_width(batched, q), ["bucket", "batch"])
    met = met.select(*[F.col(c).alias(c) for c in met.columns])
    alone = batched.where(~F.col("is_test")).select("vec_id", "bucket", "batch", "x")
    return (alone.groupBy("bucket", "batch").cogroup(met.groupBy("bucket", "batch"))
            .applyInPandas(weigh, "vec_id long, bucket long, batch long, kernel_width double, "
                                  "kappa double, weight double"))


def weighted_loss(weights: DataFrame, batched: DataFrame, prediction=None) -> DataFrame:
    """(bucket, batch, weighted_loss) = mean of w * (p - y)^2 over the batch.

    ``prediction`` is a Column; by default the constant predictor, the mean
    target of all training rows (a scalar subquery).
    """
    train = batched.where(~F.col("is_test"))
    p = prediction if prediction is not None else train.select(F.avg("y")).scalar()
    j = weights.select("vec_id", "weight").join(train.select("vec_id", "bucket", "batch", "y"), "vec_id")
    return j.groupBy("bucket", "batch").agg(
        F.avg(F.col("weight") * F.pow(p - F.col("y"), 2)).alias("weighted_loss"))


def fit_weighted_regression(batched: DataFrame, weights: DataFrame, reg_param: float = 0.01):
    """Importance-weighted least squares on the training rows: each row's
    squared error counts with its density-ratio weight (the weighted loss of
    the original, minimised by Spark ML instead of a gradient loop).
    Returns the fitted ``LinearRegressionModel``; features are ``x``."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression
    train = (batched.where(~F.col("is_test")).select("vec_id", array_to_vector("x").alias("features"), "y")
             .join(weights.select("vec_id", "weight"), "vec_id"))
    lr = LinearRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=reg_param,
                          maxIter=50, tol=1e-6)
    return lr.fit(train)


def predict_shifted(model, batched: DataFrame) -> DataFrame:
    """(vec_id, prediction) for the test rows."""
    from pyspark.ml.functions import array_to_vector
    test = batched.where(F.col("is_test")).select("vec_id", array_to_vector("x").alias("features"))
    return model.transform(test).select("vec_id", "prediction")
