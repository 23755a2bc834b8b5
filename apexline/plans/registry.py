"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, text: str, *needs: str) -> None:
    """A named common table expression for check SQL."""
    _PARTS[name] = (needs, text)


def parts_of(prefix: str, source: str, base: str, names: tuple[str, ...]) -> None:
    """The named parts once more, under a prefix, with `source` in the place of the part `base`."""
    other = {base: source} | {name: f"{prefix}_{name}" for name in names}
    table = re.compile(rf"\b(FROM|JOIN) ({'|'.join(other)})\b")
    for name in names:
        needs, text = _PARTS[name]
        renamed = table.sub(lambda m: f"{m[1]} {other[m[2]]}", text)
        part(other[name], renamed, *[other.get(n, n) for n in needs])


def sql(body: str, *needs: str) -> str:
    """Check SQL with the named expressions it needs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in _PARTS[name][0]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return body
    inner = ",\n".join(f'"{name}" AS ({_PARTS[name][1]})' for name in order)
    recursive = "RECURSIVE " if any(n.startswith("greedy") for n in order) else ""
    return f"WITH {recursive}{inner}\n{body}"


def _plain(df: DataFrame) -> DataFrame:
    """Widen result types so that they compare across engines."""
    wide = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("bigint").alias(field.name)
        elif isinstance(field.dataType, T.DecimalType):
            col = col.cast("double").alias(field.name)
        wide.append(col)
    return df.select(*wide)


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, folder: _plain(fn(spark, folder))
        if check is not None:
            CHECKS[name] = check
        return fn

    return register
