"""Side-by-side check of a Spark result against DuckDB SQL on the same Parquet.

Mirrors the driver's gate: same column names, same row count, and the same
multiset of rows (order-insensitive), after a value normalisation that
ignores float noise below 1e-6.
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import time

from meterwise.sources.tables import DRIVER_TABLES

os.environ.setdefault("TZ", "UTC")
time.tzset()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in DRIVER_TABLES:
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int,)):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict().items()))
    if hasattr(v, "item"):  # numpy scalar
        return norm(v.item())
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), str(x)) for x in row)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=_key)
    return cols, out


def digest(rows: list[tuple]) -> str:
    h = hashlib.sha256()
    for r in rows:
        h.update(repr(r).encode())
    return h.hexdigest()[:16]


def compare(spark_df, con, sql: str, show: int = 5) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    sc, sr = canonical(s_cols, s_rows)
    dc, dr = canonical(d_cols, d_rows)
    res = {
        "columns_match": sc == dc,
        "rows_spark": len(sr),
        "rows_oracle": len(dr),
        "hash_spark": digest(sr),
        "hash_oracle": digest(dr),
    }
    res["match"] = res["columns_match"] and sr == dr
    if not res["match"]:
        res["spark_columns"], res["oracle_columns"] = sc, dc
        s_set, d_set = set(map(repr, sr)), set(map(repr, dr))
        res["only_spark"] = [r for r in sr if repr(r) not in d_set][:show]
        res["only_oracle"] = [r for r in dr if repr(r) not in s_set][:show]
    return res
