"""Run registered queries in Spark and their oracle SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import time

import duckdb

from cadenza.sources.catalog_views import BASE_TABLES


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return repr(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, plan, sql, sf_dir):
    """(same, message, seconds in Spark, seconds in the oracle)."""
    start = time.time()
    df = plan(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    middle = time.time()
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    theirs = result.fetchall()
    end = time.time()
    took = (middle - start, end - middle)
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}", *took
    a, b = canonical(df.columns, ours), canonical(names, theirs)
    if a == b:
        return True, f"{len(a)} rows", *took
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    text = f"{len(a)} / {len(b)} rows; only Spark {len(only_a)}: {str(only_a[:2])[:400]}; only oracle {len(only_b)}: {str(only_b[:2])[:400]}"
    return False, text, *took
