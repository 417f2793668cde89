"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return "null" if v is None else str(v)


def canonical(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences as text; empty when both sides agree."""
    rel = con.sql(sql)
    problems = []
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} != {sorted(rel.columns)}"]
    kind = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
            "DATE": "date", "TIMESTAMP": "timestamp", "FLOAT": "float"}
    spark_types = dict(df.dtypes)
    for name, t in zip(rel.columns, rel.types):
        s = spark_types[name].replace("timestamp_ntz", "timestamp")
        if kind.get(str(t), str(t)) != s:
            problems.append(f"type of {name}: {s} != {t}")
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = canonical(rel.columns, rel.fetchall())
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        a, b = set(got), set(want)
        problems.append(f"values differ: only spark {sorted(a - b)[:3]} ({len(a - b)}) only sql {sorted(b - a)[:3]} ({len(b - a)})")
    return problems
