"""The near-duplicate stage starts from the classes of SimHash, as op2_simhash finds them, and verifies them."""

import random

import corpus_pipeline
from cases import SMALL
from test_shingles import brute as brute_sets
from test_shingles import check, near
from test_simhash import brute_classes, brute_print

from apexline.llm import shingles

SCHEMA = "doc_id long, text string"


def classes_by_print(rows):
    found = {}
    for i, _, c in brute_classes([(i, brute_print(t)) for i, t in rows]):
        found.setdefault(c, set()).add(i)
    return sorted(map(sorted, found.values()))


def test_fingerprints_alone_find_the_copies(spark, monkeypatch):
    draw = random.Random(4)
    rows = []
    for group in range(4):
        base = [f"v{draw.randrange(3000)}" for _ in range(900)]
        rows += [(10 * group + k, " ".join(near(draw, base, k))) for k in range(2)]
    assert len(classes_by_print(rows)) == len(brute_sets(rows)) == 4
    # No round over the shingles' keys.
    monkeypatch.setattr(shingles, "PIVOTS", -1)
    got = corpus_pipeline.by_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SMALL)
    check(got.collect(), rows)


def test_near_fingerprints_are_verified(spark):
    """Repeats fill most of the texts: the fingerprints are near, the sets of shingles are not."""
    draw = random.Random(4)
    same = " ".join(["a b c d e"] * 60)
    rows = [(k, f"{same} {' '.join(f'r{draw.randrange(10**6)}' for _ in range(8))}") for k in range(3)]
    assert len(classes_by_print(rows)) < len(brute_sets(rows)) == len(rows)
    got = corpus_pipeline.by_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), SMALL)
    check(got.collect(), rows)
