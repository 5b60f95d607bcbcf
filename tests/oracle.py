"""Runs registered queries and their SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def differences(frame, con, sql: str, show: int = 3) -> str:
    """Empty if both give the same rows in any order."""
    a = frame.collect()
    columns = sorted(frame.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return f"columns {columns} against {sorted(rel.columns)}"
    at = [rel.columns.index(x) for x in columns]
    left = sorted(tuple(_plain(r[x]) for x in columns) for r in a)
    right = sorted(tuple(_plain(r[k]) for k in at) for r in rel.fetchall())
    if left == right:
        return ""
    one, two = [x for x in left if x not in set(right)][:show], [x for x in right if x not in set(left)][:show]
    return f"{len(left)} against {len(right)} rows; only here {one}; only there {two}"
