"""Timeline properties on small random races."""

import random

import pytest

from apexline.operators import asof, notes, timeline


def _race(seed, cars=7, laps=3):
    """Laps with missing sectors, ties and zero-length legs, in whole seconds."""
    rng = random.Random(seed)
    rows = []
    for c in range(cars):
        t = rng.randint(0, 3)
        for lap in range(1, laps + 1):
            s = [None if rng.random() < 0.1 else rng.randint(0, 4) for _ in range(5)]
            known = sum(x for x in s if x is not None)
            t += known
            if any(x is not None for x in s):
                rows.append(
                    ("e", str(c), f"c{c % 2}", lap, s, [None] * 5, t, None, False, "d", "v")
                )
    return rows


SCHEMA = (
    "event string, car string, klass string, lap bigint, s array<bigint>, spd array<bigint>,"
    " tend bigint, rt bigint, inpit boolean, driver string, vehicle string"
)


def _walk(rows):
    """Boundary times per car by the sequential rule."""
    times = {}
    for _, car, klass, lap, s, _, tend, *_ in sorted(rows, key=lambda r: (r[1], r[3])):
        at = tend - sum(x for x in s if x is not None)
        for k, x in enumerate(s):
            if x is not None:
                at += x
                times.setdefault((klass, car), []).append((at, lap, k + 1))
    return {key: sorted(v) for key, v in times.items()}


def _counted(times):
    out = {}
    for (klass, car), own in times.items():
        for k, (t, lap, sector) in enumerate(own, start=1):
            place = 1
            for (other_class, other), theirs in times.items():
                if other_class != klass or other == car:
                    continue
                passed = [x[0] for x in theirs if x[0] <= t]
                if len(passed) > k or (len(passed) == k and passed[-1] < t):
                    place += 1
            out[car, lap, sector] = (k, place)
    return out


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_position_is_the_counting_rule(spark, seed, split):
    rows = _race(seed)
    laps = spark.createDataFrame(rows, SCHEMA)
    got = timeline.class_position(timeline.boundaries(laps, split), split).collect()
    assert {(r.car, r.lap, r.sector): (r.k, r.position) for r in got} == _counted(_walk(rows))


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_overtakes_are_all_flips(spark, seed, split):
    rows = _race(seed, cars=12)
    times = {
        (klass, car): {(lap - 1) * 5 + s: t for t, lap, s in v}
        for (klass, car), v in _walk(rows).items()
    }
    want = set()
    for (klass, car), own in times.items():
        for (other_class, other), theirs in times.items():
            if klass != other_class or car == other:
                continue
            for idx in own:
                if idx % 5 == 1 or not {idx - 1} <= own.keys() or not {idx, idx - 1} <= theirs.keys():
                    continue
                g0, g1 = own[idx - 1] - theirs[idx - 1], own[idx] - theirs[idx]
                if g0 * g1 < 0:
                    want.add((car, other, idx, g0, g1, g0 > 0))
    laps = spark.createDataFrame(rows, SCHEMA)
    positions = timeline.class_position(timeline.boundaries(laps, False), False)
    got = notes.overtakes(positions, split).collect()
    found = [(r.car, r.rival, (r.lap - 1) * 5 + r.sector, r.g0, r.g1, r.gain) for r in got]
    assert sorted(found) == sorted(want)


def test_going_back_in_time_changes_nothing(spark):
    """What is known at T is the same with and without later rows."""
    rows = _race(3)
    laps = spark.createDataFrame(rows, SCHEMA)
    legs, dim = timeline.legs(laps), timeline.car_dim(laps)
    at = 14
    for ask in (
        lambda g: asof.active_leg(g, at),
        lambda g: asof.live_position(g, dim, at, False),
        lambda g: asof.last_crossing(g, at),
        lambda g: asof.frozen_sector_marks(g, dim, at, False, False),
    ):
        assert sorted(ask(legs).collect()) == sorted(ask(legs.filter(f"t0 <= {at}")).collect())
    known = laps.filter(f"tend <= {at}")
    assert sorted(asof.last_and_fastest_lap(laps, at).collect()) == sorted(
        asof.last_and_fastest_lap(known, at).collect()
    )
    bounds = timeline.boundaries(laps, False)
    refs = dim.filter("car in ('0', '1')")
    assert sorted(asof.common_gap(bounds, refs, at).collect()) == sorted(
        asof.common_gap(bounds.filter(f"t <= {at}"), refs, at).collect()
    )
