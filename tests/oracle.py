"""Compare registered queries with DuckDB: ``python tests/oracle.py [sf_dir] [name prefix ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def make_spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    def cell(v):
        if isinstance(v, float):
            return "nan" if v != v else repr(v)
        return repr(v)
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(problem or None, rows, seconds)"""
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return None, len(rows), seconds
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    expected = got.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}", len(rows), seconds
    a, b = canonical(df.columns, rows), canonical(columns, expected)
    if a == b:
        return None, len(rows), seconds
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"rows {len(a)} vs {len(b)}; first differences of {len(diff)} {sorted(columns)}: {diff[:2]}", len(rows), seconds


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = sys.argv[2:]
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = make_spark(), connect(sf_dir)
    for block in os.environ.get("BLOCKS", "").split(","):
        if block:
            spark.conf.set("spark.saccadia.rowsPerBlock", block)
            spark.conf.set("spark.saccadia.valuesPerCell", block)
    bad = 0
    for name, fn in queries.items():
        if os.environ.get("ONLY_D") and name not in oracles:
            continue
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            problem, n, seconds = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            problem, n, seconds = f"{type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += problem is not None
        kind = "D" if name in oracles else "R"
        print(f"{'ok ' if problem is None else 'BAD'} {kind} {name} rows={n} {seconds:.2f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
