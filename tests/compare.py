"""Run queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def open_tables(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def difference(spark, connection, run, sql, sf_dir) -> str | None:
    df = run(spark, sf_dir)
    left = rows_of(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(sql)
    names = [item[0] for item in result.description]
    right = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if left == right:
        return None
    only_left = [row for row in left if row not in set(right)][:2]
    only_right = [row for row in right if row not in set(left)][:2]
    return f"{len(left)} rows vs {len(right)}; spark only {only_left}; sql only {only_right}"[:1500]


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from catalog.queries import ORACLES, QUERIES
    from tests.conftest import test_session

    spark = test_session()
    connection = open_tables(sf_dir)
    failures = 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            if name in ORACLES:
                problem = difference(spark, connection, QUERIES[name], ORACLES[name], sf_dir)
            else:
                print(f"rows {len(QUERIES[name](spark, sf_dir).collect())}", end=" ")
                problem = None
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
