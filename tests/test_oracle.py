"""Every registered query against its DuckDB oracle at sf0.01 (row count,
column names, order-insensitive values), and the contract of the entry file."""

import pytest

from conftest import SF_ORACLE, SF_SMALL
from lendframe.plans.check import compare
from lendframe.plans.oracle import ORACLES
from lendframe.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, name, SF_ORACLE)
    assert res["columns_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["match"], res


def test_every_query_has_an_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only == {"text_hash_features", "regress_predict", "holdout_mae", "density_ratio_kmm",
                         "weighted_regression", "predict_reloaded", "variant_grid"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["text_hash_features", "regress_predict"])
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "LOAN_ID"


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["LOAN_ID", "LOAN_AMOUNT"]
    assert df.count() == 300
    assert set(entry.oracle_sql()) <= set(entry.queries())


SPARK_TO_DUCKDB = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                   "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


def test_column_types_match_the_oracle(spark):
    import duckdb

    from lendframe.sources.tables import TABLES, table_path
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    bad = {}
    for name, sql in ORACLES.items():
        s = {c: SPARK_TO_DUCKDB.get(t, t) for c, t in QUERIES[name](spark, SF_SMALL).dtypes}
        rel = con.sql(sql)
        o = dict(zip(rel.columns, [str(t) for t in rel.types]))
        if s != o:
            bad[name] = (s, o)
    assert not bad, bad


def test_entry_file_works_from_another_directory(tmp_path):
    """The driver loads the entry file from elsewhere; Python workers then
    cannot import the package, so their functions must travel by value."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(
        "import importlib.util\n"
        f"spec = importlib.util.spec_from_file_location('e', {os.path.join(repo, '__spark_entry__.py')!r})\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('ROWS', m.queries()['kernel_row_sums'](s, {SF_SMALL!r}).count(), m.entry(s).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=str(tmp_path), env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 400 300" in out.stdout, out.stderr[-3000:]


@pytest.mark.parametrize("name", ["category_dictionary", "median_rate_recent", "running_mae",
                                  "corrected_submission", "category_encode_wide"])
def test_results_do_not_depend_on_adaptive_execution(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        res = compare(spark, name, SF_ORACLE)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert res["match"], res


@pytest.mark.parametrize("partitions", ["3", "31"])
def test_results_do_not_depend_on_the_partition_count(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        bad = [n for n in ("category_dictionary", "median_rate", "running_mae", "tag_frequency")
               if not compare(spark, n, SF_ORACLE)["match"]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert not bad
