"""Order-insensitive value digest shared by the oracle tests and scripts/check_oracle.py."""

from __future__ import annotations

import datetime
import hashlib
import math

import pandas as pd


def norm(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        s = v.isoformat()
        return s[:10] if s.endswith("T00:00:00") else s
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def digest(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(norm(v) for v in row) for row in df[cols].itertuples(index=False, name=None))
    return hashlib.md5("\n".join(rows).encode()).hexdigest()


def spark_frame(df) -> pd.DataFrame:
    """Rows as Python values (no pandas dtype coercion of nullable ints)."""
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)


def duck_frame(con, sql: str) -> pd.DataFrame:
    cur = con.execute(sql)
    return pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object)
