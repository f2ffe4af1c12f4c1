"""Run a query and its SQL side by side and compare rows, names and types."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

# Spark type -> the DuckDB types that hold the same values
TYPES = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR", "JSON", '"NULL"'},
         "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"}}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(sf) / (t + '.parquet')}')")
    return con


def _cell(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs, empty when the two agree."""
    rel = con.sql(sql)
    ours, theirs = dict(df.dtypes), dict(zip(rel.columns, map(str, rel.types)))
    problems = []
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} <> {sorted(theirs)}"]
    for c, t in ours.items():
        if theirs[c] not in TYPES.get(t, {t.upper()}):
            problems.append(f"type of {c}: {t} <> {theirs[c]}")
    a = _rows(df.columns, [tuple(r) for r in df.collect()])
    b = _rows(rel.columns, rel.fetchall())
    if len(a) != len(b):
        problems.append(f"rows {len(a)} <> {len(b)}")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        problems.append(f"values in {sorted(ours)}: only spark {only_a}; only sql {only_b}")
    return problems
