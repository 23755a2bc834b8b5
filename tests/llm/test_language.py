import zlib

import numpy as np
import pytest
from cases import SMALL, empty, given, odd, odd_rows

from apexline.llm import language
from apexline.llm.common import documents
from apexline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(documents(spark, SMALL))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op1_language"](spark, "/root/testdata/sf0.01").collect()}
    rows = given("documents", "/root/testdata/sf0.01", "doc_id, lang")
    assert len(got) == len(rows)
    held = [(got[i].lang_pred, y) for i, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == y for p, y in held]) > 0.95
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_odd_rows(spark, model):
    got = language.identify(odd(spark), model).collect()
    assert len(got) == len(odd_rows())
    texts = {r[0]: r[1] for r in odd_rows()}
    for r in got:
        letters = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == language.UNKNOWN) == (not letters) and (r.score > 0) == letters
    assert language.identify(empty(spark), model).count() == 0
    assert language.learn(empty(spark)) is None
    assert {r.lang_pred for r in language.identify(odd(spark), None).collect()} == {language.UNKNOWN}


def test_gradients_by_differences():
    draw = np.random.default_rng(3)
    net = language.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows = draw.integers(0, 256, (12, 5)).astype(np.uint8)
    labels, seen = np.array([0, 1, 2, 1, 0]), (draw.random((12, 5)) > 0.2).astype(np.float64)

    def loss():
        both = np.concatenate([net._layer(windows, w, None) for w in "fb"], axis=1)
        p = net._softmax(net.p["o"] @ both + net.p["c"])[:, labels, np.arange(5)]
        return -(np.log(p) * seen).sum() / seen.sum()

    grad = net.gradients(windows, labels, seen)
    for name, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 2e-3 * max(1e-3, abs(g[at])) + 1e-5, name


def test_pooled_is_the_mean_over_every_byte(model):
    network, names = model
    texts = [b"a", b"The of and in " * 40, "é ñ ü".encode(), b"x" * 64, b"y" * 65]
    got = language.pooled(network, texts)
    for text, row in zip(texts, got):
        parts = [text[k : k + language.WINDOW] for k in range(0, len(text), language.WINDOW)]
        each = []
        for p in parts:
            w = np.frombuffer(p.ljust(language.WINDOW, b"\0"), np.uint8)[:, None]
            each.append(network.probabilities(w)[: len(p), :, 0])
        assert np.allclose(row, np.concatenate(each).mean(axis=0), atol=1e-5)
