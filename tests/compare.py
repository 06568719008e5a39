"""Run a Spark query and its DuckDB oracle and compare the results.

Rows are compared as multisets: both frames are sorted on every column
(columns in name order). Integers, strings and dates must be equal;
doubles must agree to a relative 1e-9 (and are also reported when not
bit-identical).
"""

from __future__ import annotations

import datetime
import math

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_views(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, datetime.datetime):
        return v
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return v.item()
        except Exception:
            return v
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))

    def key(row):
        return tuple((0, "") if v is None else (1, str(v) if not isinstance(v, (int, float)) else v) for v in row)

    return sorted(out, key=key)


def compare(spark_df, duck_df: pd.DataFrame) -> tuple[bool, str, bool]:
    """Return (ok, message, bit_identical)."""
    s = spark_df.toPandas()
    if sorted(s.columns) != sorted(duck_df.columns):
        return False, f"columns differ: spark={sorted(s.columns)} oracle={sorted(duck_df.columns)}", False
    if len(s) != len(duck_df):
        return False, f"row count spark={len(s)} oracle={len(duck_df)}", False
    a, b = _rows(s), _rows(duck_df)
    exact = True
    cols = sorted(s.columns)
    for ra, rb in zip(a, b):
        for c, x, y in zip(cols, ra, rb):
            if x is None or y is None:
                if x is not y and not (x is None and y is None):
                    return False, f"null mismatch in {c}: {x!r} vs {y!r}", False
                continue
            if isinstance(x, float) or isinstance(y, float):
                if x != y:
                    exact = False
                    if not math.isclose(float(x), float(y), rel_tol=1e-9, abs_tol=1e-9):
                        return False, f"value mismatch in {c}: {x!r} vs {y!r}", False
            elif x != y:
                return False, f"value mismatch in {c}: {x!r} vs {y!r} ({type(x).__name__}/{type(y).__name__})", False
    return True, "ok", exact
