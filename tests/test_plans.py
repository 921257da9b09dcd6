"""
the JVM, small sides are broadcast only after their size is measured, and
no order statistic funnels a whole table through one task."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lendframe.plans.queries import QUERIES

# Queries that run Python on purpose: NumPy over bounded batches (shift)
# and Spark ML (model).
PYTHON_ALLOWED = {"kernel_width", "kernel_row_sums", "density_ratio", "density_ratio_kmm", "weighted_loss"}
ML = {"text_hash_features", "regress_predict", "holdout_mae", "weighted_regression"}


def executed_plan(df) -> str:
    """The physical plan after a run (adaptive plans are final then)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_ALLOWED - ML))
def test_no_python_in_feature_queries(spark, name):
    plan = executed_plan(QUERIES[name](spark, SF_SMALL))
    for op in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert op not in plan, (name, op)


@pytest.mark.parametrize("name", ["convert_usd", "corrected_submission"])
def test_rate_join_is_broadcast_after_measuring(spark, name):
    plan = executed_plan(QUERIES[name](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("name", ["category_dictionary", "median_rate", "running_mae"])
def test_no_window_runs_over_a_whole_group(spark, name):
    """The only windows left in these plans order the small offset table
    (one row per range partition and group), never the rows themselves."""
    import re
    plan = executed_plan(QUERIES[name](spark, SF_SMALL))
    windows = [m.group(1) for m in re.finditer(r"Window \[(.*)\]", plan)]
    assert windows
    for w in windows:
        assert re.search(r"windowspecdefinition\((\w+#\d+L?, )?_pid", w), w[:300]


def test_scan_reads_only_the_columns_it_needs(spark):
    import re
    df = QUERIES["target_stats"](spark, SF_SMALL)
    plan = executed_plan(df)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas
    for unused in ("o_comment", "o_clerk", "c_address", "n_comment"):
        assert all(unused not in s for s in schemas), unused


def test_filters_reach_the_scan(spark):
    from lendframe.operators import amount as A
    from lendframe.sources import fixtures as fx
    spark.catalog.clearCache()
    local = A.extract_local_amount(fx.loan(spark, SF_SMALL), version=2, keep=["LOAN_AMOUNT"])
    plan = local.where("LOAN_ID > 500")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,500)" in plan


def test_scale_settings_size_partitions_from_the_input():
    from lendframe.session import scale_settings
    s = scale_settings(100 * (1 << 40))
    assert int(s["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (256 << 20)
    assert int(scale_settings(1 << 20)["spark.sql.shuffle.partitions"]) == 200
