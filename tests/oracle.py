"""Run a named query on Spark and its SQL on DuckDB, and compare the rows as bags."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6)
    if value is not None and type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    begun = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    took = time.time() - begun
    if sql is None:
        return True, f"{len(rows)} rows, {took:.2f}s, no SQL"
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    expected_rows = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(columns)}"
    got, expected = bag(df.columns, rows), bag(columns, expected_rows)
    if got != expected:
        extra = list((got - expected).items())[:3]
        missing = list((expected - got).items())[:3]
        return False, f"{len(rows)} rows against {len(expected_rows)}; extra {extra}; missing {missing}"
    duck_types = {c[0]: str(c[1]) for c in result.description}
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return True, f"{len(rows)} rows, {took:.2f}s {types} {duck_types}"


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    con = duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n.startswith(a) for a in argv[1:])]
    failed = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, queries[name], sql.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
