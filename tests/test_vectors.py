"""Vector column functions against NumPy, and the text-encoder hook."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lendframe.functions import vectors as V
from lendframe.operators import model as MD
from lendframe.sources import fixtures as fx


def test_distance_and_kernel_match_numpy(spark):
    x = fx.shift(spark, SF_SMALL).where("vec_id < 20")
    pairs = x.alias("a").join(x.alias("b"), F.col("a.vec_id") + 1 == F.col("b.vec_id"))
    rows = pairs.select(F.col("a.x").alias("a"), F.col("b.x").alias("b"),
                        V.euclidean("a.x", "b.x").alias("d"), V.rbf("a.x", "b.x", 0.05).alias("k")).collect()
    assert len(rows) == 19
    for r in rows:
        a, b = np.array(r["a"]), np.array(r["b"])
        assert r["d"] == pytest.approx(np.linalg.norm(a - b), rel=1e-12)
        assert r["k"] == pytest.approx(np.exp(-0.05 * np.sum((a - b) ** 2)), rel=1e-12)


def test_missing_vector_becomes_zeros(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    got = [r[0] for r in df.select(V.zeros_if_missing("v", 2)).collect()]
    assert got == [[1.0, 2.0], [0.0, 0.0]]


def test_text_encoder_hook_runs_in_arrow_batches(spark):
    def encode(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"n_chars": texts.str.len().astype("int64")})

    loans = fx.loan(spark, SF_SMALL).select("LOAN_ID", F.col("LOAN_USE").alias("t"))
    out = MD.encoder_hook(encode, "t", "n_chars long")(loans)
    bad = out.where(F.coalesce(F.length("t"), F.lit(0)) != F.col("n_chars")).count()
    assert out.count() == loans.count() and bad == 0
