"""Runs registered queries and their SQL counterparts and compares the results as bags of rows."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return Counter(tuple(row[at] for at in order) for row in rows)


KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def difference(frame, connection, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    types = {name: str(kind) for name, kind in zip(names, (column[1] for column in result.description))}
    expected = bag(names, result.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} instead of {sorted(names)}"
    found = bag(frame.columns, [tuple(row) for row in frame.collect()])
    if found != expected:
        more, less = list((found - expected).items())[:2], list((expected - found).items())[:2]
        return f"{sum(found.values())} rows, {sum(expected.values())} expected\n  only Spark:  {more}\n  only DuckDB: {less}"
    kinds = {name: (KINDS.get(kind, kind), types[name]) for name, kind in frame.dtypes if KINDS.get(kind, kind) != types[name]}
    return f"types {kinds}" if kinds else None


if __name__ == "__main__":
    root = Path(__file__).resolve().parents[1]
    sys.path.insert(0, str(root))
    from __spark_entry__ import oracle_sql, queries
    from plaudit.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, bad = duck(sf_dir), 0
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = difference(query(spark, sf_dir), connection, oracle_sql()[name])
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{name:24s} {time.time() - start:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{bad} differ")
