"""One document of every class of near-duplicates by word shingles; exact similarity on SimHash and MinHash candidates.

Two texts are near-duplicates if their sets of shingles (WORDS words in a row, ASCII letters in lower case) have
a Jaccard similarity of at least NUM / DEN. A class is what such pairs connect.

1. Equal texts are one node, named by 128 bits of hash; copies end here.
2. A node has BANDS keys, each made of ROWS minima of its shingles' hashes. A pair of similarity 0.8 shares no
   key with a probability of (1 - 0.8 ** ROWS) ** BANDS, about three in a million; of 0.85, two in a hundred million.
3. Nodes that share a key are candidates, and every candidate is verified on the shingles themselves. Within
   a key not all pairs are verified: PIVOTS times each member is compared with one member of the key that
   is in another class so far; then what still lies in different classes is compared as a whole.
4. With a `distance`, the operator in `simhash` comes first: each text of a class of fingerprints that many bits apart
   is verified against the class's smallest; only what lies in different classes then goes through 3.

Defined cases: a text of fewer than WORDS words is one shingle; null and empty texts and texts without a word
are alike; the row with the smallest doc_id of a class stays, a null doc_id only if the class has no other;
of several such rows with that id one stays; extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexline.functions.session import cut_unsized
from apexline.llm import simhash
from apexline.llm.common import as_rows, whole_text
from apexline.llm.graph import components

WORDS = 5
# Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
BANDS, ROWS = 24, 4
PIVOTS = 3
# Shingles whose minima are taken together.
STEP = 1024

_DRAW = np.random.default_rng(5)
_ODD = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _DRAW.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes) -> set[bytes]:
    tokens = text.lower().split()
    if len(tokens) <= WORDS:
        return {b" ".join(tokens)}
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    begins = [0, *(ends[:-WORDS] + 1).tolist()]
    return {line[i:j] for i, j in zip(begins, ends[WORDS - 1 :].tolist())}


def similar(a: set, b: set) -> bool:
    common = len(a & b)
    return common * DEN >= (len(a) + len(b) - common) * NUM


def band_keys(found: set[bytes]) -> list[int]:
    """One signed number per band."""
    from xxhash import xxh64_digest, xxh64_intdigest

    hashes = np.frombuffer(b"".join(map(xxh64_digest, found)), np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), STEP):
        mixed = hashes[None, k : k + STEP] * _ODD
        mixed ^= mixed >> np.uint64(32)
        mixed += _ADD
        mixed *= _MIX
        least = np.minimum(least, mixed.min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    numbers = [xxh64_intdigest(bands[k].tobytes(), k) for k in range(BANDS)]
    return [n - (1 << 64) if n >> 63 else n for n in numbers]


def _node() -> Column:
    return F.unhex(F.md5(whole_text()))


def _nodes(docs: DataFrame, prints: bool = False) -> DataFrame:
    """node, size (number of shingles), band keys and, if asked for, SimHash of every distinct text."""

    def signed(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                sets = [shingles(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.binary()),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([band_keys(s) for s in sets], pa.list_(pa.int64())),
                        pa.array([simhash.fingerprint(t) if prints else None for t in texts], pa.int64()),
                    ],
                    ["node", "size", "keys", "fingerprint"],
                )

    rows = docs.select(_node().alias("node"), whole_text().alias("text"))
    rows = rows.mapInArrow(signed, "node binary, size int, keys array<long>, fingerprint long")
    return rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "keys", "fingerprint")])


def _linked(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of candidates from the SimHash classes: each node with the smallest of its class."""
    found = simhash.classes(nodes, distance).withColumnRenamed("fingerprint", "c_print")
    named = nodes.join(found, F.col("fingerprint") == F.col("c_print"), "left").select(
        "node", F.coalesce("root", "fingerprint").alias("root")
    )
    least = named.groupBy("root").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1")
    met = named.join(least.withColumnRenamed("root", "l_root"), F.col("root") == F.col("l_root"))
    return met.filter("node <> b").select(F.col("node").alias("a"), "b")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that are similar."""
    pairs = cut_unsized(pairs)
    needed = pairs.select("a").union(pairs.select("b")).toDF("need").distinct()
    rows = docs.select(_node().alias("node"), whole_text().alias("text"))
    rows = rows.join(needed, F.col("node") == F.col("need"), "left_semi")
    texts = rows.groupBy("node").agg(F.first("text").alias("text"))
    met = pairs.join(texts.toDF("b", "text_b"), "b").join(texts.toDF("a", "text_a"), "a")

    def judged(batches):
        for batch in batches:
            a, b = (batch.column(k).cast(pa.binary()) for k in (2, 3))
            last, known = None, set()
            keep = []
            for x, y in zip(a, b):
                x, y = x.as_py(), y.as_py()
                if y != last:
                    last, known = y, shingles(y)
                keep.append(similar(shingles(x), known))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "text_a", "text_b").mapInArrow(judged, "a binary, b binary")


def _fits(a: str, b: str) -> Column:
    """The sizes allow the similarity."""
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def _placed(met: DataFrame, links: DataFrame) -> DataFrame:
    """The members of the keys with their class by the links so far."""
    named = components(links).select(F.col("node").alias("n_node"), "root")
    return cut_unsized(met.drop("part").join(named, F.col("node") == F.col("n_node"), "left").select(
        "key", "node", "size", F.coalesce("root", "node").alias("part")
    ))


def classes(docs: DataFrame, distance: int | None = None) -> DataFrame:
    """node, root of the distinct texts that are similar to another one."""
    nodes = cut_unsized(_nodes(docs, distance is not None))
    keys = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("key").alias("s_key"))
    met = keys.join(shared, F.col("key") == F.col("s_key"), "left_semi")
    met = cut_unsized(met.select("key", "node", "size", F.col("node").alias("part")))
    links = None
    if distance is not None:
        links = cut_unsized(_verified(docs, _linked(nodes.select("node", "fingerprint"), distance)))
        met = _placed(met, links)
    for step in range(PIVOTS + 1):
        # Keys whose members are all in one class are done.
        spread = met.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"))
        mixed = spread.filter("low < high").select(F.col("key").alias("m_key"))
        met = cut_unsized(met.join(mixed, F.col("key") == F.col("m_key"), "left_semi"))
        if met.isEmpty():
            break
        if step < PIVOTS:
            draw = F.xxhash64(F.lit(step), "part")
            pivot = F.min(F.struct(draw, F.col("part"), F.col("node"), F.col("size"))).alias("pivot")
            pivots = met.groupBy("key").agg(pivot).select(
                "key", F.col("pivot.part").alias("p_part"), F.col("pivot.node").alias("b"), F.col("pivot.size").alias("p_size")
            )
            pairs = met.join(pivots, "key").filter((F.col("part") != F.col("p_part")) & _fits("size", "p_size"))
            pairs = pairs.select(F.col("node").alias("a"), "b")
        else:
            counts = met.groupBy("key", "part").count()
            main = counts.groupBy("key").agg(F.max(F.struct("count", "part"))["part"].alias("main"))
            inside = met.join(main, "key")
            outer = inside.filter("part <> main").select("key", F.col("node").alias("a"), F.col("part").alias("part_a"), F.col("size").alias("size_a"))
            # Of two outsiders one order is enough.
            once = (F.col("part_b") == F.col("main")) | (F.col("part_a") < F.col("part_b"))
            every = inside.select("key", "main", F.col("node").alias("b"), F.col("part").alias("part_b"), F.col("size").alias("size_b"))
            pairs = outer.join(every, "key").filter((F.col("part_a") != F.col("part_b")) & once & _fits("size_a", "size_b")).select("a", "b")
        found = _verified(docs, pairs.distinct())
        links = cut_unsized(found if links is None else links.union(found))
        met = _placed(met, links)
    if links is None:
        return keys.select("node", F.col("node").alias("root")).limit(0)
    return components(links)


def one_of_each(docs: DataFrame, distance: int | None = None) -> DataFrame:
    """One row of every class, with all columns."""
    found = classes(docs, distance)
    keys = docs.select(_node().alias("node"), F.col("doc_id").cast("long").alias("id"))
    counts = cut_unsized(keys.groupBy("node", "id").agg(F.count("*").alias("n")))
    named = counts.join(found.withColumnRenamed("node", "f_node"), F.col("node") == F.col("f_node"), "left").select(
        "node", "id", "n", F.coalesce("root", "node").alias("root")
    )
    # The smallest id; of equal ids the smallest node.
    place = F.struct(F.isnull("id").alias("none"), F.col("id"), F.col("node"))
    best = named.groupBy("root").agg(F.min(place).alias("best"), F.sum("n").alias("total")).filter("total > 1")
    met = named.join(best.withColumnRenamed("root", "b_root"), F.col("root") == F.col("b_root"))
    stays = (F.col("node") == F.col("best.node")) & F.col("id").eqNullSafe(F.col("best.id"))
    # Copies of the row that stays are tied; all other rows of a class go.
    judged = cut_unsized(met.filter(~stays | (F.col("n") > 1)).select("node", "id", stays.alias("tied")))
    rows = as_rows(docs).withColumn("node", F.unhex(F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))))
    same = lambda other: (rows["node"] == other["j_node"]) & rows["id"].eqNullSafe(other["j_id"])
    taken = judged.toDF("j_node", "j_id", "tied")
    kept = rows.join(taken, same(taken), "left_anti").select("row")
    tied = taken.filter("tied")
    if not tied.isEmpty():
        again = rows.join(tied, same(tied), "left_semi")
        again = again.groupBy("node", "id").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
        kept = kept.union(again)
    return kept.select("row.*")
