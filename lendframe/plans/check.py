"""Compare a Spark query with its DuckDB oracle (row count, column names,
order-insensitive values).  Used by the tests and from the command line:

    python -m lendframe.plans.check [sf_dir] [name ...]
"""

from __future__ import annotations

import collections
import math
import sys

from lendframe.sources.tables import TABLES, table_path


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "toArray"):
        return tuple(_norm(float(x)) for x in v.toArray())
    return v


def duckdb_rows(sql: str, sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return cols, cur.fetchall()


def compare(spark, name: str, sf_dir: str) -> dict:
    from lendframe.plans.oracle import ORACLES
    from lendframe.plans.queries import QUERIES
    df = QUERIES[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    out = {"name": name, "spark_rows": len(s_rows)}
    if name not in ORACLES:
        out["oracle"] = False
        return out
    o_cols, o_rows = duckdb_rows(ORACLES[name], sf_dir)
    out["oracle_rows"] = len(o_rows)
    out["columns_match"] = sorted(s_cols) == sorted(o_cols)
    if not out["columns_match"]:
        out["spark_cols"], out["oracle_cols"] = s_cols, o_cols
        out["match"] = False
        return out
    s_order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    o_order = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
    s_bag = collections.Counter(tuple(_norm(r[i]) for i in s_order) for r in s_rows)
    o_bag = collections.Counter(tuple(_norm(r[i]) for i in o_order) for r in o_rows)
    out["match"] = s_bag == o_bag
    if not out["match"]:
        only_s = list((s_bag - o_bag).elements())[:3]
        only_o = list((o_bag - s_bag).elements())[:3]
        out["only_spark"], out["only_oracle"] = only_s, only_o
        out["n_diff"] = sum((s_bag - o_bag).values())
    return out


def main(argv):
    from lendframe.plans.queries import QUERIES
    from lendframe.session import get_session
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")] or list(QUERIES)
    spark = get_session()
    bad = 0
    for n in names:
        try:
            res = compare(spark, n, sf_dir)
        except Exception as exc:  # report and go on
            res = {"name": n, "error": repr(exc)[:500]}
        ok = res.get("match", res.get("oracle") is False and "error" not in res)
        bad += not ok
        print(("OK   " if ok else "FAIL ") + str(res), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
