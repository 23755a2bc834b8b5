import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import SMALL, empty, given, odd, odd_rows, pairs

from apexline.llm import spelling
from apexline.llm.queries import QUERIES


def brute_words(rows):
    total = Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    """All pairs that share a piece around one missing letter, then the rule itself."""
    places, near = defaultdict(set), defaultdict(set)
    for w in words:
        places[w].add(w)
        for k in range(len(w)):
            places[w[:k] + w[k + 1 :]].add(w)
    for group in places.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda u: (-words[u], u), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words[form[w]] if form[w] else None, root)
    return out


def rows_of(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_given_documents(spark):
    rows = pairs(given("documents", SMALL, "doc_id, text"))
    assert rows_of(QUERIES["op12_spelling"](spark, SMALL)) == brute(brute_words(rows))


@pytest.mark.parametrize("sizes", [dict(), dict(region=16, limit=7)])
def test_regions_and_grids_lose_nothing(spark, sizes):
    """Many words of few letters, so that whole classes have the same letters; small regions and blocks."""
    draw = random.Random(3)
    words = {"".join(draw.choice("abeé") for _ in range(draw.choice([6, 6, 7, 8]))): draw.choice([5, 6, 30, 200, 1100]) for _ in range(500)}
    for w in ("x" * 70_000, "x" * 70_001, "lettres", "letters", "Lettres"):
        words[w] = 9
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(df, **sizes)) == brute(words)


def test_near_vectors_against_all_pairs():
    draw = np.random.default_rng(5)
    points, asked = draw.integers(0, 3, (300, 9)).astype(np.int16), draw.integers(0, 3, (120, 9)).astype(np.int16)
    for radius in (1, 2):
        apart = np.abs(asked[:, None] - points[None]).sum(axis=2)
        got = {(int(a), int(b)) for x, y in spelling.near_vectors(points, asked, radius) for a, b in zip(x, y)}
        assert got == set(zip(*map(list, map(lambda v: v.tolist(), np.nonzero(apart == radius)))))


def test_every_word_in_one_region_and_balls_reach_all():
    draw = random.Random(9)
    words = ["".join(draw.choice("etaoin") for _ in range(8)) for _ in range(900)]
    vectors = spelling._counts(spelling._codes(words))
    tree = spelling.Regions(vectors[:100], 16)
    home = np.full(len(words), -1)
    for r, rows in tree.reached(vectors, 0):
        assert (home[rows] == -1).all()
        home[rows] = r
    assert (home >= 0).all() and len(set(home)) > 4
    reach = {(r, int(k)) for r, rows in tree.reached(vectors, 2) for k in rows}
    apart = np.abs(vectors[:, None, :] - vectors[None]).sum(axis=2)
    assert all((home[b], int(a)) in reach for a, b in zip(*np.nonzero(apart <= 2)))


def test_odd_rows(spark):
    rows = [(r[0], r[1] or "") for r in odd_rows()] * 5
    got = rows_of(spelling.variants(spelling.vocabulary(odd(spark).union(odd(spark)).union(odd(spark)).union(odd(spark)).union(odd(spark)))))
    assert got == brute(brute_words(rows)) and got
    assert spelling.variants(spelling.vocabulary(empty(spark))).count() == 0
