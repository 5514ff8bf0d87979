"""Compare a Spark result with DuckDB SQL on the same parquet tables."""

from __future__ import annotations

import math

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duckdb_frame(sql: str, sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(pdf) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(None if (v is not None and not isinstance(v, str) and _isna(v)) else v)
                         for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def _isna(v):
    try:
        import pandas as pd
        r = pd.isna(v)
        return bool(r) if not hasattr(r, "__len__") else False
    except Exception:
        return False


def compare(spark_df, sql: str, sf_dir: str) -> dict:
    s = spark_df.toPandas()
    d = duckdb_frame(sql, sf_dir)
    res = {"spark_rows": len(s), "oracle_rows": len(d),
           "columns_match": sorted(s.columns) == sorted(d.columns)}
    if res["columns_match"]:
        rs, rd = rows_of(s), rows_of(d)
        res["values_match"] = rs == rd
        if not res["values_match"]:
            diff = [(a, b) for a, b in zip(rs, rd) if a != b][:3]
            res["first_diffs"] = diff
    else:
        res["values_match"] = False
        res["spark_cols"], res["oracle_cols"] = list(s.columns), list(d.columns)
    return res
