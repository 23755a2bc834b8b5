"""Near-duplicates by SimHash: fingerprints joined on pigeonhole blocks, verified by Hamming distance.

A fingerprint's 64 bits are cut into `BLOCKS` blocks. Two fingerprints at `distance` or fewer
differing bits agree in at least BLOCKS - distance blocks, so they meet under one of the keys made of
that many blocks. Equal fingerprints are one node from the start.

Within a key not all pairs are emitted. Every member is first compared with the key's smallest
member; components of these links are found; then, where a key still holds several components, the
members outside its largest one are compared with all the others. A pair left out that way lies in
one component already, so the classes are those of all pairs.

Defined cases: null and empty texts and texts without a word have fingerprint zero and link like any
other; repeated rows each give a row; a null doc_id gives a row and never names a class unless the
whole class has none; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.session import cut_unsized
from apexline.llm.common import slices, whole_text, with_ids
from apexline.llm.graph import components

SEED = 42
BLOCKS = 7
_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_COLUMN = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, words: int = 4) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included."""
    from xxhash import xxh64_digest

    tokens = text.lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        digests = xxh64_digest(b" ".join(tokens), SEED)
    else:
        line = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        begins = [0, *(ends[:-words] + 1).tolist()]
        digests = b"".join(
            [xxh64_digest(line[i:j], SEED) for i, j in zip(begins, ends[words - 1 :].tolist())]
        )
    octets = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * counts.ravel() > len(octets)).astype(np.uint8)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, *, words: int = 4) -> DataFrame:
    """doc_id and fingerprint (bigint) of every whole text."""

    def hashed(batches):
        for ids, texts in slices(batches):
            prints = [fingerprint(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(hashed, "doc_id long, fingerprint long")


def block_masks(distance: int) -> list[int]:
    """Masks of which any two fingerprints within the distance share at least one."""
    edges = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
    blocks = [((1 << j) - 1) ^ ((1 << i) - 1) for i, j in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(blocks, BLOCKS - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(a: str, b: str, distance: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def classes(prints: DataFrame, distance: int = 4) -> DataFrame:
    """fingerprint, root of the distinct fingerprints that link to another one."""
    distinct = prints.select(F.col("fingerprint").alias("fp")).distinct()
    masks = block_masks(distance)
    keys = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"),
    )
    shared = keys.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot"))
    # Spark sizes the keys like the fingerprints that they are exploded from, and would send them all.
    shared = shared.filter("n > 1").hint("merge")
    met = cut_unsized(keys.join(shared, ["mask", "key"]).select("mask", "key", "fp", "pivot"))
    star = met.filter((F.col("fp") != F.col("pivot")) & _near("fp", "pivot", distance))
    star = cut_unsized(star.select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct())
    first = components(star)

    known = first.select(F.col("node").alias("fp"), "root")
    placed = met.join(known, "fp", "left").select(
        "mask", "key", "fp", F.coalesce("root", "fp").alias("part")
    )
    placed = cut_unsized(placed)
    parts = placed.groupBy("mask", "key", "part").count()
    mixed = parts.groupBy("mask", "key").agg(
        F.count("*").alias("parts"), F.max(F.struct("count", "part"))["part"].alias("main")
    )
    mixed = mixed.filter("parts > 1")
    inside = placed.join(mixed, ["mask", "key"])
    outer = inside.filter("part <> main").select(
        "mask", "key", F.col("fp").alias("a"), F.col("part").alias("part_a")
    )
    every = inside.select("mask", "key", F.col("fp").alias("b"), F.col("part").alias("part_b"))
    cross = outer.join(every, ["mask", "key"]).filter(
        (F.col("part_a") != F.col("part_b")) & _near("a", "b", distance)
    )
    # The links left are between parts: find classes of parts, and follow them.
    between = cross.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct()
    joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("last"))
    nodes = cut_unsized(placed.select("fp", F.col("part").alias("root")).distinct())
    return nodes.join(joined, "root", "left").select(
        F.col("fp").alias("fingerprint"), F.coalesce("last", "root").alias("root")
    )


def near_duplicates(docs: DataFrame, *, words: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (bigint) and component_id, the smallest doc_id of the class."""
    prints = cut_unsized(fingerprints(docs, words=words))
    firsts = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    known = firsts.join(classes(prints, distance), "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    named = known.groupBy("root").agg(F.min("first").alias("component_id"))
    members = known.select("fingerprint", "root").join(named, "root").select("fingerprint", "component_id")
    return prints.join(members, "fingerprint").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, *, words: int = 4, distance: int = 4) -> DataFrame:
    """The documents that name their class; rows without an id cannot be told apart and stay."""
    found = near_duplicates(docs, words=words, distance=distance)
    return with_ids(docs, found.filter("doc_id <> component_id").select("doc_id"), kept=False)
