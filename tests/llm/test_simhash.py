import pytest
from cases import SMALL, empty, given, odd, odd_rows, pairs
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from apexline.llm import graph, simhash
from apexline.llm.queries import QUERIES


def brute_print(text, words=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    tokens = [w for w in low.split(" ") if w]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(items):
    """items: (id, print). id lists by print, linked at four bits or fewer."""
    prints = sorted({p for _, p in items})
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= 4:
                root[find(q)] = find(p)
    least = {}
    for doc, p in items:
        if doc is not None:
            least[find(p)] = min(least.get(find(p), doc), doc)
    return {(doc, f"{p:016x}", least.get(find(p))) for doc, p in items}


def test_whole_table(spark):
    got = {tuple(r) for r in QUERIES["op2_simhash"](spark, SMALL).collect()}
    rows = pairs(given("documents", columns="doc_id, text"))
    assert got == brute_classes([(i, brute_print(t)) for i, t in rows])


def test_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == len(odd_rows())
    want = brute_classes([(r[0], brute_print(r[1] or "")) for r in odd_rows()])
    assert {(r.doc_id, f"{r.fingerprint % (1 << 64):016x}", r.component_id) for r in got} == want
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.one_of_each(odd(spark))
    assert kept.columns == odd(spark).columns
    named = {c for _, _, c in want}
    assert {r.doc_id for r in kept.collect()} == named | {None}


@pytest.mark.parametrize("seed", range(3))
def test_classes_of_crowded_prints(spark, seed):
    """Many prints around few centres: chains, crowds and outsiders under the same keys."""
    import random

    draw = random.Random(seed)
    prints = []
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(80):
            p = centre
            for _ in range(draw.choice([0, 1, 2, 3, 6, 9])):
                p ^= 1 << draw.randrange(64)
            prints.append(p)
    items = list(enumerate(prints))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in items]
    table = spark.createDataFrame(signed, "doc_id long, fingerprint long")
    found = {r.fingerprint % (1 << 64): r.root for r in simhash.classes(table).collect()}
    want = {p: c for _, p, c in ((i, int(h, 16), c) for i, h, c in brute_classes(items))}
    groups = {}
    for _, p in items:
        groups.setdefault(found.get(p, p), set()).add(want[p])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_masks_leave_no_near_pair_out():
    import random

    masks, draw = simhash.block_masks(4), random.Random(1)
    for _ in range(500):
        flips = sum(1 << b for b in draw.sample(range(64), 4))
        assert any(flips & m == 0 for m in (m % (1 << 64) for m in masks))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(1000, 1000 + k) for k in range(1, 200)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{1000 + k: 1000 for k in range(200)}}
    none = spark.createDataFrame([], "a long, b long")
    assert graph.components(none).count() == 0
    assert graph.components(spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_exploded_keys_are_not_broadcast(spark, monkeypatch):
    """Spark sizes the keys like the fingerprints below them, whose size it knows once they are shuffled."""
    rows = spark.range(2000).select((F.col("id") * 7).alias("fingerprint"))
    plans, kind = [], type(rows)
    checkpoint = kind.checkpoint

    def spied(df, eager=True):
        kept = checkpoint(df, eager)
        if not plans:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0])
        return kept

    monkeypatch.setattr(kind, "checkpoint", spied)
    simhash.classes(rows)
    assert "Generate posexplode" in plans[0]
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_guessed_size_does_not_grow_with_the_steps(spark):
    """A chain needs several steps; the product of their joins' sizes must not be carried through them."""
    chain = [(k * 5 % 13, (k + 1) * 5 % 13) for k in range(12)]
    found = graph.components(spark.createDataFrame(chain, "a long, b long"))
    assert found.select("root").distinct().count() == 1 and found.count() == 13
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64
