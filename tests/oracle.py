"""Runs registered queries against their SQL in DuckDB."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _value(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(row[i]) for i in order) for row in rows), key=repr)


def compare(connection, frame, sql):
    """Differences as text, empty if there are none."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} but SQL has {sorted(names)}"
    expected = _rows(names, result.fetchall())
    got = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    if got == expected:
        return ""
    here, there = set(got), set(expected)
    only, missing = list(here - there)[:2], list(there - here)[:2]
    return f"{len(got)} rows but SQL has {len(expected)}; only here {only}; only there {missing}"[:3000]
