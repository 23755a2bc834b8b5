import hashlib
import random

import numpy as np
import pytest
from cases import SMALL, empty, given, odd, odd_rows

from apexline.llm import suffixes
from apexline.llm.queries import QUERIES


def brute(rows):
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    seen, out = set(), {}
    for doc in sorted(texts, key=lambda d: (d is not None, d)):
        text = texts[doc]
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 99):
            piece = text[k : k + 100]
            if piece in seen:
                gone[k : k + 100] = True
            seen.add(piece)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out[doc] = (len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        digest = r.kept_sha256 if "kept_sha256" in r else hashlib.sha256(bytes(r.kept)).hexdigest()
        assert (r.n_bytes, r.n_removed, r.n_spans, digest) == want[r.doc_id], r.doc_id


def test_whole_table(spark):
    check(QUERIES["op6_suffixes"](spark, SMALL).collect(), given("documents", columns="doc_id, text"))


def test_odd_rows(spark):
    check(suffixes.deduplicate(odd(spark)).collect(), odd_rows())
    assert suffixes.deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_mixtures(spark, seed, monkeypatch):
    """Few letters, shared passages cut anywhere, periodic texts, tiny slices and blocks."""
    monkeypatch.setattr(suffixes, "REDUCED_BYTES", 3000)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 700)
    draw = random.Random(seed)
    passages = ["".join(draw.choice("abé \n") for _ in range(draw.randint(90, 400))) for _ in range(8)]
    rows = []
    for k in range(80):
        parts = []
        for _ in range(draw.randint(1, 4)):
            kind = draw.random()
            if kind < 0.6:
                p = draw.choice(passages)
                i = draw.randint(0, 60)
                parts.append(p[i : len(p) - draw.randint(0, 60)])
            elif kind < 0.7:
                parts.append(draw.choice(["a", "ab", "abc "]) * draw.randint(10, 150))
            else:
                parts.append("".join(draw.choice("xyz ") for _ in range(draw.randint(1, 200))))
        rows.append((k * 7 % 80, "".join(parts)))
    check(suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_multikey_order():
    draw = np.random.default_rng(2)
    for _ in range(20):
        columns = [draw.integers(0, k, 300) for k in (3, 4, 1000)]
        order = suffixes.multikey_order(columns)
        assert (order == np.lexsort(columns[::-1])).all()
    assert len(suffixes.multikey_order([np.zeros(0, int), np.zeros(0, int)])) == 0


def test_every_window_has_its_own_anchor_among_the_anchors():
    draw = np.random.default_rng(4)
    texts = [bytes(draw.integers(97, 101, n, dtype=np.uint8)) for n in (100, 101, 350, 168)] + [b"ab" * 120]
    block = suffixes.Block(texts)
    anchors = set(block.anchors().tolist())
    own = block.own_anchor()
    assert all(int(own[k]) in anchors and k <= own[k] <= k + suffixes.REACH for k in np.flatnonzero(block.inside))
