"""Compares query results with DuckDB's over the same tables."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, Decimal):
        return plain(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def difference(spark_rows, columns, con, sql) -> str:
    """Empty if both hold the same rows under the same names, in any order."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(columns):
        return f"columns {sorted(columns)} and {sorted(names)}"
    order, theirs = sorted(columns), Counter()
    at = [names.index(c) for c in order]
    for row in cursor.fetchall():
        theirs[tuple(plain(row[i]) for i in at)] += 1
    ours = Counter(tuple(plain(r[c]) for c in order) for r in spark_rows)
    if ours == theirs:
        return ""
    return f"{order}: {sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
