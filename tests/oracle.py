"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import glob
import math
import os
from decimal import Decimal

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"create view {name} as select * from read_parquet('{files}')")
    return db


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, list | tuple):
        return tuple(map(_plain, x))
    if isinstance(x, Decimal):
        return float(x)
    return str(x) if hasattr(x, "isoformat") else x


def compare(spark, db, name: str, run, sql: str, sf_dir: str = DATA) -> str:
    """Empty if both agree, else what differs."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]).upper() for d in result.description}
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} and {len(want)} rows"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{name}: {a} and {b}"
    spark_kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "decimal(2,1)": "DECIMAL(2,1)"}
    other = [(c, k, kinds[c]) for c, k in df.dtypes if spark_kinds.get(k, k) != kinds[c]]
    return f"{name}: types {other}" if other else ""
