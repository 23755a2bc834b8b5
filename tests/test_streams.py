"""Streams over several micro-batches against the batch operators."""

import json
import os
import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from apexline.operators import ingest, sampling
from apexline.sources import frames as feed
from apexline.sources.standins import Frames, Timing
from apexline.streaming import live

COLUMNS = ["event_date", "pid", "frame_no", "event", "received", "payload"]


@pytest.fixture(scope="module", params=["in time", "shuffled"])
def dropped(spark, tmp_path_factory, request):
    """Frames as JSON files: later frames in later files, or dealt out by a hash."""
    folder = str(tmp_path_factory.mktemp("frames"))
    frames = Frames(Timing(spark, SMALL)).log.select(*COLUMNS).cache()
    cuts = frames.approxQuantile("received", [0.25, 0.5, 0.75], 0.0)
    for n, (low, high) in enumerate(zip([0, *cuts], [*cuts, 1e18])):
        part = (F.col("received") > low) & (F.col("received") <= high)
        if request.param == "shuffled":
            part = F.pmod(F.xxhash64("frame_no"), F.lit(4)) == n
        frames.filter(part).coalesce(1).write.mode("append").json(folder)
    return folder, frames


def _run(start, spark, dropped, tmp_path, **options):
    stream = start(
        live.read_frames(spark, dropped[0], 1), str(tmp_path / "out"), str(tmp_path / "check"),
        once=True, **options,
    )
    stream.awaitTermination()
    assert stream.exception() is None
    return str(tmp_path / "out")


def test_timing_table(spark, dropped, tmp_path):
    path = _run(live.stream_timing, spark, dropped, tmp_path)
    want = ingest.merge_latest_rows(live.timing_rows(dropped[1])).drop("frame_no")
    got = live.read_timing(spark, path).select(want.columns)
    keep = [c for c in want.columns if c not in ("received", "event_date")]
    assert sorted(map(str, got.select(keep).collect())) == sorted(
        map(str, want.select(keep).collect())
    )
    versions = spark.read.parquet(f"{path}/rows")
    assert versions.count() < live.timing_rows(dropped[1]).count()
    # Days over are rewritten as one row a lap, and the table stays.
    before, rows = sorted(map(str, live.read_timing(spark, path).collect())), versions.count()
    for day in sorted(d.split("=")[1] for d in os.listdir(f"{path}/rows") if "=" in d)[:2]:
        live.compact_timing(spark, path, day)
        assert len(os.listdir(f"{path}/rows/event_date={day}")) == 1
    assert sorted(map(str, live.read_timing(spark, path).collect())) == before
    assert spark.read.parquet(f"{path}/rows").count() <= rows


def test_status(spark, dropped, tmp_path):
    path = _run(live.stream_timing, spark, dropped, tmp_path)
    stream = live.stream_status(live.read_frames(spark, dropped[0], 1), path, f"{path}-status", once=True)
    stream.awaitTermination()
    assert spark.read.parquet(f"{path}/status").select("batch").distinct().count() == 4
    want = feed.live_status(dropped[1], ingest.merge_latest_rows(live.timing_rows(dropped[1])))
    assert sorted(map(str, live.read_status(spark, path).collect())) == sorted(map(str, want.collect()))


def _shown(n, car, lap, at, text, **more):
    body = {"STNR": car, "LAPS": lap, "S1TIME": text, "TAGESZEIT": "12:00:00", **more}
    payload = {"PID": "0", "EXPORTID": "R", "TRACKNAME": "Nordschleife", "RESULT": [body]}
    return ("2026-03-14", "0", n, "R", at, json.dumps(payload))


def _feed(spark, folder, batches):
    """One JSON file a batch, read in this order."""
    for n, frames in enumerate(batches):
        spark.createDataFrame(frames, live.FRAME_SCHEMA).coalesce(1).write.mode("append").json(folder)
        newest = max((f for f in os.scandir(folder) if f.name.endswith(".json")), key=lambda f: f.stat().st_mtime_ns)
        os.utime(newest.path, (1_000_000 + n, 1_000_000 + n))


@pytest.mark.parametrize("order", [(0, 1, 2), (0, 2, 1), (1, 2, 0)])
def test_an_old_version_never_wins(spark, tmp_path, order):
    """1:00 at 5, the same at 10, 2:00 at 7: the row is 1:00 as of 10, whatever comes first."""
    frames = [_shown(1, "7", 3, 5, "1:00"), _shown(2, "7", 3, 10, "1:00"), _shown(3, "7", 3, 7, "2:00")]
    _feed(spark, str(tmp_path / "in"), [[frames[k]] for k in order])
    path = _run(live.stream_timing, spark, (str(tmp_path / "in"),), tmp_path)
    got = live.read_timing(spark, path).collect()
    assert [(r.received, r.s1, r.frame_no) for r in got] == [(10, 60_000, 2)]
    live.compact_timing(spark, path, "2026-03-14")
    assert [(r.received, r.s1) for r in live.read_timing(spark, path).collect()] == [(10, 60_000)]


@pytest.mark.parametrize("seed", range(2))
def test_timing_and_pits_for_any_order(spark, tmp_path, seed):
    """Random versions, ties of time and falling counters, dealt into batches at random."""
    draw = random.Random(seed)
    frames = []
    for n in range(60):
        car, at = draw.choice("79"), draw.randrange(40) * 300_000
        lap = at // 2_000_000 + draw.choice([0, 0, 0, 1])
        counter = max(0, at // 3_000_000 + draw.choice([0, 0, 0, -1]))
        frames.append(_shown(n, car, lap, at, draw.choice(["1:00", "2:00", "-"]), PITSTOPCOUNT=counter))
    shuffled = draw.sample(frames, len(frames))
    _feed(spark, str(tmp_path / "in"), [shuffled[k::4] for k in range(4)])
    every = spark.createDataFrame(frames, live.FRAME_SCHEMA)
    path = _run(live.stream_timing, spark, (str(tmp_path / "in"),), tmp_path)
    pits = str(tmp_path / "pits")
    stream = live.stream_pit_counter(live.read_frames(spark, str(tmp_path / "in"), 1), pits, f"{pits}-check", once=True)
    stream.awaitTermination()
    laps = ingest.pit_from_counter(live.counted_rows(every), False).collect()
    assert sorted(live.read_pit_laps(spark, pits).collect()) == sorted(laps) and laps
    want = ingest.merge_latest_rows(live.timing_rows(every))
    got = live.read_timing(spark, path, pits)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert {tuple(r) for r in got.filter("inpit").select("event", "car", "lap").collect()} == {tuple(r) for r in laps}
    live.compact_timing(spark, path, "2026-03-14")
    assert sorted(map(str, live.read_timing(spark, path).select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_changed_order_takes_a_pit_lap_back(spark, tmp_path):
    """2 then 3 is a stop on lap 6; a 3 between them, on lap 5, moves it."""
    shown = [_shown(n, "7", lap, at, "1:00", PITSTOPCOUNT=c) for n, lap, at, c in [(1, 5, 100, 2), (2, 6, 900, 3), (3, 5, 500, 3)]]
    _feed(spark, str(tmp_path / "in"), [[f] for f in shown])
    path = _run(live.stream_pit_counter, spark, (str(tmp_path / "in"),), tmp_path)
    assert [r.lap for r in live.read_pit_laps(spark, path).collect()] == [5]
    # Equal order of laps and counters: nothing is written again.
    assert spark.read.parquet(path).agg(F.max("version")).first()[0] == 3


def test_nothing_of_earlier_batches_is_read(spark, dropped, tmp_path):
    """The rows of a stream are a function of the batch and keyed state; no table is opened."""
    rows = live.timing_changes(live.timing_rows(live.read_frames(spark, dropped[0], 1)))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 1 and "Join" not in plan and plan.count("FlatMapGroupsInPandasWithState") == 1


def test_pit_counter(spark, dropped, tmp_path):
    path = _run(live.stream_pit_counter, spark, dropped, tmp_path)
    want = ingest.pit_from_counter(live.counted_rows(dropped[1]), False).distinct()
    assert sorted(live.read_pit_laps(spark, path).collect()) == sorted(want.collect())


def test_messages_once(spark, dropped, tmp_path):
    path = _run(live.stream_messages, spark, dropped, tmp_path)
    got = live.read_messages(spark, path)
    want = ingest.merge_messages(feed.map_messages(dropped[1]))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_late_message_is_kept(spark, tmp_path):
    """A message five days older than what came before it, and a repeat of an early one."""
    day = 86_400_000

    def frame(n, at, text):
        body = '{"PID": "3", "MESSAGES": [{"MESSAGETIME": "10:00:00", "MESSAGE": "%s"}]}' % text
        return (f"2026-03-{10 + at // day:02d}", "3", n, "e", at, body)

    folder = str(tmp_path / "in")
    for n, (at, text) in enumerate([(6 * day, "# 5 fine"), (7 * day, "# 6 fine"), (day, "# 7 late"), (6 * day + 1, "# 5 fine")]):
        spark.createDataFrame([frame(n, at, text)], live.FRAME_SCHEMA).coalesce(1).write.mode("append").json(folder)
    path = _run(live.stream_messages, spark, (folder,), tmp_path)
    got = live.read_messages(spark, path).collect()
    assert sorted((r.message, r.received) for r in got) == [("# 5 fine", 6 * day), ("# 6 fine", 7 * day), ("# 7 late", day)]


def _greedy(times, gap):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


def test_frame_archive(spark, dropped, tmp_path):
    gap = 7_200_000
    path = _run(live.stream_frame_archive, spark, dropped, tmp_path)
    rows = dropped[1].filter("pid <> 'LTS_TIMESYNC'").collect()
    want, seen = set(), set()
    for key in {(r.event_date, r.pid) for r in rows}:
        mine = [r for r in rows if (r.event_date, r.pid) == key]
        for t in _greedy({r.received for r in mine}, gap):
            first = min((r for r in mine if r.received == t), key=lambda r: (r.frame_no, r.event))
            if (key, first.payload) not in seen:
                seen.add((key, first.payload))
                want.add((*key, t))
    got = live.read_frame_archive(spark, path, min_ms=gap).collect()
    assert {(r.event_date, r.pid, r.received) for r in got} == want
    days = sorted({w[0] for w in want})[:2]
    for day in [*days, days[0]]:
        live.settle_frames(spark, path, day, min_ms=gap)
    # What is stored of these days now is what stays, and the archive reads the same.
    stored = spark.read.parquet(path).filter(F.col("event_date").isin(days))
    assert stored.count() == sum(w[0] in days for w in want)
    again = live.read_frame_archive(spark, path, min_ms=gap).filter(F.col("event_date").isin(days)).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in got if r.event_date in days)


@pytest.mark.parametrize("slice_ms", [60_000, sampling.SLICE_MS])
@pytest.mark.parametrize("gap", [900, 15_000, 4_000_000])
def test_sampling_is_greedy(spark, gap, slice_ms):
    rng = random.Random(gap)
    rows = []
    for channel in ("0", "4", None):
        t = 0
        for i in range(250):
            t += rng.choice([0, 1, 200, gap - 1, gap, 40_000])
            rows.append(("2026-01-01", channel, i, "e", t, f"{i}"))
    frames = spark.createDataFrame(rows, "event_date string, pid string, frame_no int, event string,"
                                   " received bigint, payload string")
    got = sampling.sample_frames(frames, gap, slice_ms=slice_ms).collect()
    for channel in ("0", "4", None):
        mine = [r for r in rows if r[1] == channel]
        want = _greedy({r[4] for r in mine}, gap)
        assert sorted(r.received for r in got if r.pid == channel) == want
    assert sampling.sample_frames(frames, 0).count() == len(rows)
