import random

import corpus_pipeline
import pytest
from cases import SMALL, empty, given, odd, odd_rows

from apexline.llm import shingles

SCHEMA = "doc_id long, text string"


def sets(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Classes (lists of places in rows) by the Jaccard similarity of all pairs."""
    found = [sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(found[i] & found[j]) >= 4 * len(found[i] | found[j]):
                root[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(rows[i])
    return out.values()


def check(got, rows):
    """One row of each class, with the smallest id."""
    got = [tuple(r) for r in got]
    groups = list(brute(rows))
    assert len(got) == len(groups)
    for group in groups:
        stay = [r for r in got if r in group]
        ids = [r[0] for r in group if r[0] is not None]
        assert len(stay) == 1 and stay[0][0] == min(ids, default=None)


def near(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"w{draw.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", range(2))
def test_stage_against_all_pairs(spark, seed):
    """Near copies on both sides of 0.8, chains, repeated ids and missing ones."""
    draw = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"v{draw.randrange(3000)}" for _ in range(draw.choice([8, 60, 300]))]
        for k in range(12):
            rows.append((draw.choice([None, *range(60)]), " ".join(near(draw, base, draw.randrange(len(base) // 20 + 2)))))
        rows += draw.sample(rows, 2)
    # A row's place in its class is told by its text here.
    got = corpus_pipeline.by_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), SMALL).collect()
    check(got, rows)
    assert len(got) < len(set(rows))


def test_near_copies_that_four_bits_miss(spark):
    draw = random.Random(3)
    base = [f"v{k}" for k in range(200)]
    rows = [(1, " ".join(base))] + [(k, " ".join(near(draw, base, 3))) for k in range(2, 8)]
    rows += [(20, "equal ids, other text"), (20, "equal ids, other text"), (None, "no id here"), (None, "no id here")]
    got = corpus_pipeline.by_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SMALL).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 20]


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    check(shingles.one_of_each(docs).collect(), given("documents", columns="doc_id, text"))


def test_odd_rows(spark):
    got = shingles.one_of_each(odd(spark))
    assert got.columns == odd(spark).columns
    check([r[:2] for r in got.collect()], [r[:2] for r in odd_rows()])
    assert shingles.one_of_each(empty(spark)).count() == 0


def test_crowds_meet_however_the_pivots_fall(spark, monkeypatch):
    draw = random.Random(9)
    base = [f"v{k}" for k in range(100)]
    rows = [(k, " ".join(near(draw, base, draw.choice([0, 1, 2, 3])))) for k in range(60)]
    for pivots in (0, 1):
        monkeypatch.setattr(shingles, "PIVOTS", pivots)
        check(shingles.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect(), rows)
