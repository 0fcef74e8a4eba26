"""Spark-vs-DuckDB comparison used by the tests and ``check_oracle.py``:
row count, column names and an order-insensitive multiset of rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from nutrilake.sources.tables import TABLES


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, digits) if digits is not None else v
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return v


def rows_of(records, cols, digits):
    return Counter(tuple(_norm(r[c], digits) for c in cols) for r in records)


def compare(spark, fn, sql: str | None, sf_dir: str, digits: int | None = 9) -> dict:
    sdf = fn(spark, sf_dir)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    out = {"spark_rows": len(srows), "spark_cols": sorted(sdf.columns)}
    if sql is None:
        return out
    con = duck_connect(sf_dir)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [dict(zip(dcols, r)) for r in res.fetchall()]
    out.update({"duck_rows": len(drows), "duck_cols": sorted(dcols)})
    out["cols_match"] = sorted(dcols) == sorted(sdf.columns)
    out["rows_match"] = len(drows) == len(srows)
    if out["cols_match"]:
        cols = sorted(dcols)
        a, b = rows_of(srows, cols, digits), rows_of(drows, cols, digits)
        out["values_match"] = a == b
        if a != b:
            out["only_spark"] = list((a - b).items())[:3]
            out["only_duck"] = list((b - a).items())[:3]
    else:
        out["values_match"] = False
    return out
