import numpy as np
import pytest
from cases import SMALL, given

from apexline.llm import whitening
from apexline.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n int"


def brute(vectors):
    """Every figure of the contract in numpy and whole numbers."""
    kept = {i: [int(v) for v in np.floor(256 * np.asarray(e, float))] for i, e in vectors}
    fit = sorted({tuple(x) for x in kept.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    far = {i: sum((n * v - s) ** 2 for v, s in zip(x, sums)) for i, x in kept.items()}
    white = {i: (np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values) for i, x in kept.items()}
    return n, far, white, values / np.trace(centred.T @ centred / n)


def test_against_numpy(spark):
    got = QUERIES["op13_whitening"](spark, SMALL).collect()
    rows = [(i, e) for i, e in given("embeddings", SMALL, "vec_id, embedding")]
    n, far, white, explained = brute(rows)
    assert len(got) == 4 * len(rows)
    for k in range(1, 5):
        mine = {r.vec_id: r for r in got if r.component == k}
        one = next(iter(mine))
        sign = np.sign(mine[one].whitened * white[one][k - 1])
        for i, r in mine.items():
            assert r.n == n and r.deviation == far[i] and r.identity_error < 1e-9
            assert abs(sign * r.whitened - white[i][k - 1]) < 1e-8
            assert abs(r.explained - explained[k - 1]) < 1e-10


@pytest.mark.parametrize("d", [2, 3, 40])
def test_few_and_many_dimensions(spark, d):
    draw = np.random.default_rng(d)
    rows = [(k, [float(v) for v in draw.normal(size=d) * np.arange(1, d + 1)], 0, "x", 1) for k in range(80)]
    rows += rows[:5]  # repeated rows count once in the fit and come back as often as they are there
    v = whitening.whole_vectors(spark.createDataFrame(rows, SCHEMA))
    model = whitening.learn(v)
    got = whitening.whiten(v, model).collect()
    assert len(got) == 85 * min(4, d) and model.n == 80 and model.identity_error < 1e-9
    fit = np.array([[int(np.floor(256 * np.float64(np.float32(c)))) for c in r[1]] for r in rows[:80]], float)
    values = np.linalg.eigvalsh(np.cov(fit.T, bias=True))[::-1][: min(4, d)]
    assert np.allclose(model.values, values, rtol=1e-11)


def test_odd_rows(spark):
    fine = [(k, [1.0 * k, 2.0 * (k % 3)], 0, "x", 1) for k in range(6)]
    nan, inf = float("nan"), float("inf")
    odd = [(90, None, 0, "x", 1), (91, [1.0, None], 0, "x", 1), (92, [nan, 1.0], 0, "x", 1), (93, [1.0, -inf], 0, "x", 1),
           (94, [], 0, "x", 1), (95, [1.0, 2.0, 3.0], 0, "x", 1), (None, [1.0, 2.0], None, None, None)]
    v = whitening.whole_vectors(spark.createDataFrame(fine + odd, SCHEMA))
    got = whitening.whiten(v, whitening.learn(v)).collect()
    assert {r.id for r in got} == {0, 1, 2, 3, 4, 5, None} and len(got) == 14
    for rows in ([], fine[:1], [(k, [3.0, 4.0], 0, "x", 1) for k in range(3)]):
        v = whitening.whole_vectors(spark.createDataFrame(rows, SCHEMA))
        assert whitening.learn(v) is None and whitening.whiten(v, None).count() == 0
    # Along a line only one component is real.
    v = whitening.whole_vectors(spark.createDataFrame([(k, [1.0 * k, 2.0 * k, 0.0], 0, "x", 1) for k in range(9)], SCHEMA))
    assert {r.component for r in whitening.whiten(v, whitening.learn(v)).collect()} == {1}


def test_deviation_is_exact_or_null():
    big = np.array([[1 << 40, -(1 << 40)], [1 << 52, 5]], np.int64)
    sums = [(1 << 52) + (1 << 40), 5 - (1 << 40)]
    want = [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in big]
    assert whitening._deviations(big, 2, sums) == [v if v < 1 << 63 else None for v in want]
    assert whitening._deviations(big // (1 << 30), 2, [3, 4]) == [
        sum((2 * int(v) - s) ** 2 for v, s in zip(row, [3, 4])) for row in big // (1 << 30)
    ]
