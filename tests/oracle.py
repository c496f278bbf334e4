"""Runs a query and its SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    con.execute("SET TimeZone = 'UTC'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> str:
    """Empty if columns, rows and values agree, else what doesn't."""
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = rows(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    have = rows(df.columns, df.collect())
    if have != want:
        return f"{sum(have.values())} rows against {sum(want.values())}; only here {list((have - want).items())[:3]}; only there {list((want - have).items())[:3]}"
    return ""
