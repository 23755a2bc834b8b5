"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apexline.functions.session import cut

# Stands for a missing doc_id, so that joins are on plain values; it sorts before all others.
MISSING = -(1 << 63)
# Repeated ids are sent to every executor up to this many, and shuffled beyond.
SENT_IDS = 1_000_000
# Bytes of text that one step inside a Python worker handles together.
SLICE_BYTES = 1 << 22


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches, *, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts as UTF-8) of Arrow batches of (id, text), cut so that a slice stays small.

    A single text over the limit is a slice of its own.
    """
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        begin, held = 0, 0
        for k, text in enumerate(texts):
            size = 0 if text is None else len(text)
            if held and held + size > limit:
                yield ids[begin:k], [t or b"" for t in texts[begin:k]]
                begin, held = k, 0
            held += size
        if ids[begin:]:
            yield ids[begin:], [t or b"" for t in texts[begin:]]


def as_rows(docs: DataFrame) -> DataFrame:
    """id and row (all columns as one struct), so that no name of a document's columns can clash."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*columns).alias("row"))


def with_ids(docs: DataFrame, ids: DataFrame, *, kept: bool) -> DataFrame:
    """The documents whose id is among the ids (one column), or the others."""
    other = ids.toDF("other").filter("other is not null").distinct()
    met = as_rows(docs).join(other, F.col("id") == F.col("other"), "left_semi" if kept else "left_anti")
    return met.select("row.*")


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """again: the ids that several rows have; None if there are none."""
    counts = docs.groupBy(F.col("doc_id").cast("long").alias("again")).count()
    again = cut(counts.filter("again is not null and count > 1").select("again"))
    n = again.count()
    return None if n == 0 else F.broadcast(again) if n <= SENT_IDS else again


def with_keys(rows: DataFrame, text: Column, again: DataFrame | None) -> DataFrame:
    """rows, which have an id, with the key of their (id, text).

    The key is struct<id, a, b>, of which a and b are 128 bits of the text's hash where the id is missing or repeated
    and zero elsewhere, so that other rows carry nothing that does not pack away.
    """
    told = F.col("id").isNull()
    columns = rows.columns
    if again is not None:
        rows = rows.join(again, F.col("id") == F.col("again"), "left")
        told = told | F.col("again").isNotNull()
    none = F.lit(0).cast("long")
    key = F.struct(
        F.coalesce("id", F.lit(MISSING)).alias("id"),
        F.when(told, F.xxhash64(text)).otherwise(none).alias("a"),
        F.when(told, F.xxhash64(F.lit(1), text)).otherwise(none).alias("b"),
    )
    return rows.select(*columns, key.alias("key"))
