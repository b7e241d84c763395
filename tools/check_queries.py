"""Compare registered queries with their SQL: python tools/check_queries.py [sf] [query ...]"""

from __future__ import annotations

import importlib.util
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str:
    """An empty text where both sides agree, else what differs."""
    result = con.execute(sql)
    expected = rows_of([c[0] for c in result.description], result.fetchall())
    actual = rows_of(df.columns, df.collect())
    if actual[0] != expected[0]:
        return f"columns {sorted(set(actual[0]) ^ set(expected[0]))}"
    if actual[1] == expected[1]:
        return "" if actual[1] else "no rows"
    extra, missing = (
        sorted(set(a) - set(b))[:2] for a, b in ((actual[1], expected[1]), (expected[1], actual[1]))
    )
    return f"{len(actual[1])} rows against {len(expected[1])}\n    spark {extra}\n    sql   {missing}"


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main(sf: str = "sf0.01", *names: str) -> int:
    entry = load_entry()
    folder = f"/root/testdata/{sf}"
    spark, con = session(), connect(folder)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        started = time.time()
        try:
            if name in oracles:
                problem = compare(queries[name](spark, folder), con, oracles[name])
            else:
                problem = "" if queries[name](spark, folder).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':4} {name:32} {time.time() - started:6.2f}s {problem}", flush=True)
    print(f"{failed} failed; without SQL: {sorted(set(queries) - set(oracles))}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(*sys.argv[1:]))
