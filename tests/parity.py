"""Compare a registered query with its check SQL."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    return type(v).__name__


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    return v


def _key(row):
    return tuple((x is None, type(x).__name__, str(x)) for x in row)


def compare(df, con, text):
    """Empty string when equal, else what differs."""
    cols = sorted(df.columns)
    got = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    raw = cur.fetchall()
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(_norm(r[i]) for i in at) for r in raw]
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for i, c in enumerate(cols):
        a = {_kind(r[i]) for r in got} - {None}
        b = {_kind(r[i]) for r in want} - {None}
        if a != b:
            return f"types of {c}: {a} against {b}"
    ours, theirs = Counter(got), Counter(want)
    if ours != theirs:
        a = sorted((ours - theirs).elements(), key=_key)
        b = sorted((theirs - ours).elements(), key=_key)
        shown = dict(zip(cols, a[0])), dict(zip(cols, b[0]))
        return f"{len(a)} of {len(got)} rows differ: {shown[0]} against {shown[1]}"
    return ""
