import zlib

import numpy as np
import pytest
from cases import SMALL, empty, given, odd, odd_rows

from apexline.llm import quality
from apexline.llm.common import documents
from apexline.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"
HAN = "".join(chr(0x4E00 + k) for k in range(400))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op10_quality"](spark, MIDDLE).collect()}
    assert len(got) == len(given("documents", MIDDLE, "doc_id"))
    labels = dict(given("labels", MIDDLE, "doc_id, quality"))
    held = [(got[i].predicted, y, got[i].score) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean([p == y for p, y, _ in held]) > 0.95
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_held_out_accuracy_without_odd_marks(spark):
    """Bad texts that hold none of the marks that bad texts often hold."""
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r.predicted for r in QUERIES["op10_quality"](spark, folder).collect()}
    texts = dict(given("documents", folder, "doc_id, text"))
    held = [(i, y) for i, y in given("labels", folder, "doc_id, quality") if zlib.crc32(str(i).encode()) % 3 == 1]
    bad = [got[i] == 0 for i, y in held if y == 0 and not set(texts[i] or "") & set("|!")]
    assert len(bad) > 50 and np.mean(bad) > 0.95
    assert np.mean([got[i] for i, y in held if y == 1]) > 0.98


@pytest.mark.parametrize("letters, blank", [("abcdefghijklmnop", " "), ("абвгдежзиклмн", " "), (HAN, "")])
def test_wording_alone_tells_labels_apart(letters, blank):
    """Texts of one shape, the labels of which differ in their words only; with and without blanks."""
    draw = np.random.default_rng(3)
    words = ["".join(draw.choice(list(letters), 6)) for _ in range(300)]
    rows = []
    for _ in range(1200):
        good = draw.random() < 0.7
        at = np.concatenate((draw.integers(0, 300, 60), draw.integers(0, 150, 40) + (0 if good else 150)))
        rows.append((blank.join(words[k] for k in draw.permutation(at)), int(good)))
    terms, labels = quality._terms_of([t.encode() for t, _ in rows]), np.array([y for _, y in rows])
    space = quality.Space(terms[:800], labels[:800], 0.7)
    assert np.mean((space.scores(terms[800:]) >= 0.5) == labels[800:]) >= 0.88


def test_terms_of_words():
    def part(text):
        return quality.term_counts(text.encode())[quality._SHAPES : quality._SHAPES + quality.WORD_TERMS]

    one, two = part("alpha"), part("beta")
    assert (one > 0).sum() == 1 and (two > 0).sum() == 1 and one.argmax() != two.argmax()
    assert np.array_equal(part("  Alpha\tbeta\n"), part("alpha beta"))
    both = part("alpha beta")
    assert (both > 0).sum() == 3 and both[one.argmax()] > 0 and both[two.argmax()] > 0
    assert not np.array_equal(part("beta alpha"), both)
    packed = quality._packed(quality.term_counts(b"a b c"))
    assert np.array_equal(quality._unpacked(packed), quality.term_counts(b"a b c"))


def test_axes_against_the_whole_decomposition():
    draw = np.random.default_rng(2)
    rows = (draw.normal(size=(90, 6)) * [9, 7, 5, 4, 3, 2]) @ draw.normal(size=(6, 200)) + draw.normal(size=(90, 200)) * 0.01
    axes = quality.leading_axes(rows.astype(np.float32), 5)
    whole = np.linalg.svd(rows, full_matrices=False)[2][:5]
    assert np.allclose(np.abs((axes * whole).sum(axis=1)), 1, atol=1e-3)


def test_votes_against_all_pairs():
    draw = np.random.default_rng(1)
    terms, labels = np.abs(draw.normal(size=(60, quality.TERMS))).astype(np.float32), draw.integers(0, 2, 60)
    space = quality.Space(terms, labels, 0.8)
    some = np.abs(draw.normal(size=(7, quality.TERMS))).astype(np.float32)
    got = space.scores(some)
    for row, score in zip(some, got):
        v = (row * space.weights) @ space.axes
        near = [max(0.0, float(v @ w / np.linalg.norm(v))) for w in space.vectors]
        best = sorted(range(60), key=lambda k: -near[k])[: quality.NEIGHBOURS]
        weight = [near[k] ** quality.SHARPNESS * space.votes[k] for k in best]
        assert abs(score - sum(w for w, k in zip(weight, best) if labels[k]) / sum(weight)) < 1e-3


def test_odd_rows(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    space = quality.learn(documents(spark, SMALL), labels)
    got = quality.score(odd(spark), space)
    assert got.count() == len(odd_rows()) and got.filter("score is null or score < 0 or score > 1").count() == 0
    by_text = {}
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    for r in got.collect():
        assert by_text.setdefault(texts[r.doc_id], r.score) == r.score
    assert quality.score(empty(spark), space).count() == 0
    assert quality.learn(documents(spark, SMALL), labels.limit(0)) is None
    assert {r.score for r in quality.score(odd(spark), None).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1), (1, None), (999999, 1)], "doc_id long, quality int")
    assert quality.learn(documents(spark, SMALL), nulls) is None
