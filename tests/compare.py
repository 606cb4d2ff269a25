"""Run bound queries against their SQL twins and report differences.

usage: python tests/compare.py [folder] [query-or-module ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# Queries that SQL can't express, and the test that checks their values.
OWN_TESTS = {
    "ridership_boosting": "test_models.py::test_boosting_beats_the_mean", "reliability_forest": "test_models.py::test_forest_beats_the_mean",
    "delay_classification": "test_models.py::test_classes_beat_the_most_common", "ridership_forecast": "test_models.py::test_forecast_follows_the_series",
    "delay_feature_importance": "test_models.py::test_importance_is_ranked_and_sums_to_one",
}


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else ("f", round(v, 9) + 0.0)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def connect(folder: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    return con


def compare(spark, con, folder, name, fn, sql):
    """Returns (ok, message, spark seconds)."""
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(x) for x in df.collect()]
    took = time.time() - t0
    if sql is None:
        return name in OWN_TESTS, f"rows={len(got)} (no SQL twin; values: {OWN_TESTS.get(name, 'no test')})", took
    t0 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t0
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} vs {sorted(cols)}", took
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return True, f"rows={len(a)} sql={sql_took:.1f}s", took
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return False, f"rows {len(a)} vs {len(b)} cols={sorted(cols)}\n   spark {only_a}\n   sql   {only_b}", took


def main(argv):
    from stopflow.plans import catalog
    from stopflow.session import build_session
    folder = argv[0] if argv else "/root/testdata/sf0.001"
    wanted = argv[1:]
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"})
    spark.sparkContext.setLogLevel("ERROR")
    import logging
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    con = connect(folder)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        module = fn.__closure__[0].cell_contents.__module__.rsplit(".", 1)[-1]
        if wanted and module not in wanted and name not in wanted:
            continue
        try:
            ok, message, took = compare(spark, con, folder, name, fn, catalog.ORACLES.get(name))
        except Exception as e:  # report and go on
            ok, message, took = False, f"{type(e).__name__}: {str(e).splitlines()[0][:600]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:40s} {took:6.2f}s {message}", flush=True)
    print(f"failures: {bad}")
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
