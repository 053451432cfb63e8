"""Compare a query's rows with those of its SQL in DuckDB: names, types in kind, and values."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        at = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if all agrees, else what doesn't."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    kinds = {c[0]: str(c[1]) for c in rel.description}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))[:8]}"
    fit = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}
    if wrong := [(c, k, kinds[c]) for c, k in df.dtypes if k in fit and fit[k] != kinds[c]]:
        return f"types {wrong[:5]}"
    mine, theirs = rows_of(df.columns, df.collect()), rows_of(names, rel.fetchall())
    if mine != theirs:
        return f"rows {mine.total()} and {theirs.total()}; only here {list((mine - theirs).items())[:2]}; only there {list((theirs - mine).items())[:2]}"[:1500]
    return ""
