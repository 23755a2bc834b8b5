"""Ordered scans: the split form against plain Python."""

import random
import statistics

import pytest

from apexline.functions import ordered as o


def _rows(seed):
    """A key holding a third and more of all rows, with ties and gaps."""
    rng = random.Random(seed)
    keys = ["hot"] * 60 + [rng.choice("abcd") for _ in range(60)]
    return [
        (key, rng.randint(0, 12), i, rng.choice([None, *range(9)])) for i, key in enumerate(keys)
    ]


def _expected(rows):
    out = {}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for n, (_, t, i, v) in enumerate(group):
            before = [r[3] for r in group[:n] if r[3] is not None]
            upto = before + ([v] if v is not None else [])
            out[i] = (
                n + 1,
                1 + sum(r[1] < t for r in group),
                sum(upto) if upto else None,
                min(before) if before else None,
                max(upto) if upto else None,
                upto[-1] if upto else None,
                group[n - 1][3] if n else None,
                group[n + 1][3] if n + 1 < len(group) else None,
            )
    return out


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_scan(spark, seed, split):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v bigint")
    got = o.scan(
        df, ["k"], ["t", "i"],
        {
            "n": o.number(), "r": o.rank("t"), "s": o.total("v"), "lo": o.lowest("v", before=True),
            "hi": o.highest("v"), "la": o.latest("v"), "p": o.previous("v"), "f": o.following("v"),
        },
        hot=split,
    ).collect()
    assert {r.i: (r.n, r.r, r.s, r.lo, r.hi, r.la, r.p, r.f) for r in got} == _expected(rows)


def test_one_instant_for_all_rows_splits_too(spark):
    df = spark.range(200).selectExpr("'x' as k", "7L as t", "id as i")
    got = o.scan(df, ["k"], ["t", "i"], {"n": o.number(), "r": o.rank("t")}, hot=True).collect()
    assert sorted(r.n for r in got) == list(range(1, 201))
    assert {r.r for r in got} == {1}


def test_no_key_at_all(spark):
    df = spark.range(100).selectExpr("id as i")
    got = o.scan(df, [], ["i"], {"n": o.number(), "p": o.previous("i")}, hot=True).collect()
    assert {r.i: (r.n, r.p) for r in got} == {
        i: (i + 1, i - 1 if i else None) for i in range(100)
    }


def test_hot_group_is_found(spark, hot):
    df = spark.createDataFrame([("a",)] * 21 + [("b",)] * 3, "k string")
    assert o.has_hot_group(df, ["k"])
    assert not o.has_hot_group(df.filter("k = 'b'"), ["k"])
    assert o.has_hot_group(df, [])


@pytest.mark.parametrize("split", [False, True])
def test_medians(spark, split):
    rows = [(k, v, i) for k, _, i, v in _rows(5)]
    df = spark.createDataFrame(rows, "k string, v bigint, i bigint")
    got = {r.k: r.m for r in o.medians(df, ["k"], "v", ["i"], "m", split).collect()}
    known = {}
    for k, v, _ in rows:
        if v is not None:
            known.setdefault(k, []).append(v)
    assert got == {k: 2 * statistics.median(v) for k, v in known.items()}


def test_medians_by_counting(spark):
    """Far values, negative ones, equal ones, a null key, and keys named like inner columns."""
    rows = [("a", 5)] * 50 + [("a", -(1 << 60)), ("a", 1 << 60), ("b", -3), ("b", 4), ("c", None), (None, 9)]
    rows += [("d", v * 10**13) for v in range(101)] + [("e", -7)]
    rows += [("f", 1 << 20), ("f", (1 << 20) + 1), ("f", 2), ("f", 1 << 40)]
    df = spark.createDataFrame(rows, "c string, v bigint")
    known = {}
    for k, v in rows:
        if v is not None:
            known.setdefault(k, []).append(v)
    # By hand: floats are too coarse for these values.
    want = {k: sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2] for k, v in known.items()}
    for split in (False, True):
        got = {r.c: r.m for r in o.medians(df, ["c"], "v", [], "m", split).collect()}
        assert got == want
    none = o.medians(df.filter("v is null"), ["c"], "v", [], "m", True)
    assert none.count() == 0 and none.columns == ["c", "m"]


@pytest.mark.parametrize("split", [False, True])
def test_legs_in_use(spark, split):
    """Times of a leg grow together where they touch or lie inside one another."""
    from apexline.operators.asof import legs_in_use

    times = {1: [(0, 10), (10, 12), (3, 5), (20, 30)], 2: [(7, 9), (1, 2), (2, 3), (1, 3)]}
    rows = [("e", "k", f"c{i}", 4, sector, a, b) for sector, t in times.items() for i, (a, b) in enumerate(t)]
    spans = spark.createDataFrame(rows, "event string, klass string, car string, lap long, sector long, t0 long, until long")
    got = sorted((r.leg, r.since, r.until) for r in legs_in_use(spans, split).collect())
    assert got == [(20, 0, 12), (20, 20, 30), (21, 1, 3), (21, 7, 9)]
