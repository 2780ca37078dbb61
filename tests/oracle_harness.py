"""Run a registered query on Spark and its SQL oracle on DuckDB and compare.

Mirrors the driver's check: row count, column names, order-insensitive values.
Doubles are compared after rounding to 6 places.
"""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None   # pandas turns nulls of nullable numeric columns into NaN
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf: pd.DataFrame) -> list:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df, sql: str, con) -> dict:
    sp = spark_df.toPandas()
    dk = con.execute(sql).fetchdf()
    res = {"spark_rows": len(sp), "oracle_rows": len(dk),
           "cols_match": sorted(sp.columns) == sorted(dk.columns)}
    if not res["cols_match"]:
        res["spark_cols"], res["oracle_cols"] = sorted(sp.columns), sorted(dk.columns)
        res["match"] = False
        return res
    kinds = lambda df: {c: ("int" if str(t).startswith(("int", "Int", "uint")) else
                            "float" if str(t).startswith("float") else str(t)) for c, t in df.dtypes.items()}
    ks, kd = kinds(sp), kinds(dk)
    res["dtype_diffs"] = {c: (str(sp.dtypes[c]), str(dk.dtypes[c])) for c in sp.columns
                          if c in dk.columns and str(sp.dtypes[c]) != str(dk.dtypes[c])
                          and len(sp) and len(dk)}
    a, b = rows_of(sp), rows_of(dk)
    res["match"] = a == b
    if not res["match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["first_diffs"] = diff
    return res
