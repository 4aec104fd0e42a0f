"""Run queries beside their SQL in DuckDB and report differences.

usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(value + 0.0)
    if isinstance(value, Decimal):
        return repr(float(value))
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day).isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def compare(spark, connection, run, sql, sf_dir):
    """None when equal, else a short description of the first difference."""
    df = run(spark, sf_dir)
    rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(rows)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(rows)
    if len(rows) != len(expected):
        return f"{len(rows)} rows != {len(expected)}", len(rows)
    different = [(a, b) for a, b in zip(rows, expected) if a != b]
    if different:
        return f"{len(different)} rows differ, first {sorted(names)}: {different[0]}", len(rows)
    return None, len(rows)


def main():
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    failed = 0
    oracle = entry.oracle_sql()
    for name, run in entry.queries().items():
        if chosen and not any(name == c or (c.endswith("*") and name.startswith(c[:-1])) for c in chosen):
            continue
        start = time.time()
        try:
            problem, n = compare(spark, connection, run, oracle.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem, n = f"{type(error).__name__}: {" ".join(str(error).split())[:330]}", -1
        kind = "sql " if name in oracle else "rows"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {name:32s} {n:8d} rows "
              f"{time.time() - start:6.1f}s {problem or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
