"""Run registered queries next to their SQL and report differences.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _key(row: tuple) -> tuple:
    return tuple((value is not None, str(value)) for value in row)


def _plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=_key)


def difference(spark: SparkSession, connection: duckdb.DuckDBPyConnection, query, sql: str, folder: str) -> str | None:
    """None if query and SQL agree in columns and values, else what differs."""
    frame = query(spark, folder)
    ours = rows_of(frame.columns, frame.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    if not ours:
        return "no rows"
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b or list(map(type, a)) != list(map(type, b))]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main() -> int:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failed = database(folder), 0
    for name in chosen:
        started = time.time()
        sql = entry.oracle_sql().get(name)
        if sql is None:
            rows = len(entry.queries()[name](spark, folder).collect())
            problem = None if rows else "no rows"
        else:
            problem = difference(spark, connection, entry.queries()[name], sql, folder)
        failed += problem is not None
        print(f"{name:28s} {time.time() - started:6.1f}s {'rows only' if sql is None else ''} {problem or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
