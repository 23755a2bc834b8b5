import zlib

import numpy as np
import pytest
from cases import SMALL, empty, given, odd, odd_rows

from apexline.llm import toxicity
from apexline.llm.common import documents
from apexline.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.1"
PLAIN = "you are an idiot and a loser and this is stupid and worthless trash said the moron to the clown"


@pytest.fixture(scope="module")
def channel(spark):
    return toxicity.Channel(toxicity.language_model(documents(spark, MIDDLE)))


def test_counts_are_of_all_documents():
    texts = ["abca ab", "", "ÄB9b", "x--y"]
    got = toxicity.trigram_counts(texts)
    s = toxicity._SYMBOLS
    a, b, c = 1, 2, 3
    assert got[(0 * s + a) * s + b] == 2 and got[(a * s + b) * s + c] == 1 and got[(a * s + b) * s + 0] == 1
    # Runs of other signs are one end; texts do not run into each other.
    assert got[(24 * s + 0) * s + 25] == 1 and got[(b * s + 0) * s + b] == 1
    # Only the margins have two ends in a row.
    assert got.reshape(s, s, s)[:, 0, 0].sum() == 1 and got[:s].sum() == 1


@pytest.mark.parametrize("shown, meant", [
    ("1d10t", "idiot"), ("i d i o t", "idiot"), ("w.o.r.t.h.l.e.s.s", "worthless"), ("idiiiiot", "idiot"),
    ("p4th3t1c", "pathetic"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("st*pid", "stupid"), ("iiddiioott", "idiot"),
    ("l0$er, and tr@sh!", "loser, and trash!"),
])
def test_disguises_are_undone(channel, shown, meant):
    assert channel.restore(shown) == meant


@pytest.mark.parametrize("text", ["", "the house of 2024", "born in 1999, 4 pm", "a b", "10.0.0.255 and x.y", "jo.81@ab.de", "🙂 日本語"])
def test_plain_texts_stay(channel, text):
    assert channel.restore(text) == text


def test_viterbi_is_the_best_of_all_readings():
    """Against trying every reading of short pieces."""
    draw = np.random.default_rng(2)
    counts = np.zeros(toxicity._SYMBOLS**3)
    counts[draw.integers(0, len(counts), 4000)] = draw.integers(1, 50, 4000)
    model = toxicity.Model(counts)
    channel = toxicity.Channel(model)

    def cost(letters):
        total, a, b = 0.0, 0, 0
        for x in [*letters, " "]:
            s = int(toxicity._TABLE[ord(x)])
            if s or b:
                total += float(model.costs[a, b, s])
                a, b = b, s
            elif x in toxicity.LOOKALIKES:
                total += toxicity.EDGE
        return total

    def readings(text, before="", run=1):
        if not text:
            yield "", 0.0
            return
        c = text[0]
        edges = channel._edges(c, before)
        run = run + 1 if c == before else 1
        if run > 2 and len(edges) == 2:
            edges = [(c, toxicity.THIRD), edges[1]]
        for rest, price in readings(text[1:], c, run):
            for letter, own in edges:
                yield letter + rest, own + price

    for text in ("1d10t", "aab", "bbbbb", "a3a4", "!0$", "x11y", "zz0zz"):
        best = min(cost(r) + p for r, p in readings(text))
        found = channel.decode(text)
        assert abs(min(cost(r) + p for r, p in readings(text) if r == found) - best) < 1e-3


def test_held_out_rows(spark):
    got = {r.doc_id: r for r in QUERIES["op11_toxicity"](spark, MIDDLE).collect()}
    assert len(got) == len(given("documents", MIDDLE, "doc_id"))
    held = [(got[i].predicted, y) for i, y in given("labels", MIDDLE, "doc_id, toxic") if zlib.crc32(str(i).encode()) % 4 == 2]
    bad = [p for p, y in held if y]
    assert len(bad) > 50 and np.mean(bad) > 0.85 and np.mean([p for p, y in held if not y]) < 0.02
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_disguised_copies_score_like_plain_ones(spark):
    docs = documents(spark, MIDDLE)
    judge = toxicity.learn(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    clean = "the reading of this and that then on the other thing in the end was for all of them"
    rows = [(1, PLAIN), (2, PLAIN.replace("idiot", "1d10t").replace("loser", "l o s e r").replace("stupid", "stuuupid")), (3, clean)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), judge).collect()}
    assert got[1] > 0.9 and got[2] > 0.9 and got[3] < 0.3
    some = spark.createDataFrame([(1, "1d10t"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.restored for r in toxicity.restored(some, judge.model).collect()} == {1: "idiot", 2: None}


def test_odd_rows(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    judge = toxicity.learn(documents(spark, SMALL), labels)
    got = toxicity.score(odd(spark), judge).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    by_text, texts = {}, {r[0]: r[1] or "" for r in odd_rows()}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.score) == r.score
    assert toxicity.score(empty(spark), judge).count() == 0
    none = toxicity.learn(empty(spark), labels.limit(0))
    assert {r.score for r in toxicity.score(odd(spark), none).collect()} == {0.0}
    nulls = spark.createDataFrame([(None, 1), (1, None), (999999, 1), (999998, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd(spark), toxicity.learn(odd(spark), nulls)).collect()} == {0.5}
