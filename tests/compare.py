"""Runs registered queries and their SQL on the same tables and compares rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            source = f"{path}/*.parquet" if os.path.isdir(path) else path
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{source}')")
    return db


def cells(row, names) -> tuple:
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, float):
            return f"{v + 0.0:.5f}" if abs(v) < 1e9 else f"{v:.9e}"
        return str(v)

    return tuple(one(row[n]) for n in names)


def differences(spark_rows: list, spark_names: list[str], sql: str, db) -> list[str]:
    rel = db.sql(sql)
    names = sorted(rel.columns)
    if names != sorted(spark_names):
        return [f"columns {sorted(spark_names)} and {names}"]
    theirs = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    if len(theirs) != len(spark_rows):
        return [f"rows {len(spark_rows)} and {len(theirs)}"]
    a, b = sorted(cells(r, names) for r in spark_rows), sorted(cells(r, names) for r in theirs)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not near(x, y)]
    return [f"{len(wrong)} rows differ, such as {wrong[0]} of {names}"] if wrong else []


def near(x: tuple, y: tuple) -> bool:
    """Equal but for a last digit that rounding moved."""

    def same(u, v):
        if u == v:
            return True
        try:
            return abs(float(u) - float(v)) <= 2e-5 * max(1.0, abs(float(u)))
        except ValueError:
            return False

    return all(same(u, v) for u, v in zip(x, y, strict=True))
