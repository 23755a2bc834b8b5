"""The same race from export files and from the feed gives the same positions."""

import json

from pyspark.sql import functions as F

from apexline.operators import archive, ingest, live_laps, results, timeline
from apexline.sources import frames as feed
from apexline.sources.sector_csv import read_sector_csv

SECTORS = {
    ("7", 1): (86_200, 90_000, 160_100, 250_300, 61_900), ("7", 2): (85_200, 91_000, 161_100, 251_300, 62_900),
    ("9", 1): (86_300, 90_500, 160_000, 250_000, 61_000), ("9", 2): (86_000, 90_000, 160_500, 250_500, 61_500),
    ("11", 1): (87_300, 91_500, 161_000, 251_000, 62_000), ("11", 2): (80_000, 90_000, 160_500, 250_500, 61_500),
}
START = 43_200_000


def _text(ms):
    return f"{ms // 60_000}:{ms % 60_000 / 1000:06.3f}"


def _clock(ms):
    return f"{ms // 3_600_000}:{ms // 60_000 % 60:02d}:{ms % 60_000 / 1000:06.3f}"


def _ends():
    at, ends = {}, {}
    for (car, lap), s in sorted(SECTORS.items(), key=lambda x: (x[0][0], x[0][1])):
        at[car] = at.get(car, START) + sum(s)
        ends[car, lap] = at[car]
    return ends


def test_feed_and_export_agree(spark, tmp_path):
    ends = _ends()
    head = "STNR;RUNDE_NR;KLASSEKURZ;TAGESZEIT;RUNDENZEIT_IN_SEKUNDEN;" + ";".join(f"SEKTOR{i}_ZEIT" for i in range(1, 6))
    rows = [
        ";".join([c, str(n), "SP9", _clock(ends[c, n]), _text(sum(s)), *map(_text, s)]) for (c, n), s in SECTORS.items()
    ]
    (tmp_path / "race.CSV").write_text("\n".join([head, *rows, ""]), encoding="cp1252")
    export = read_sector_csv(spark, str(tmp_path)).withColumn("event", F.lit("R"))

    frames = []
    for n, ((car, lap), s) in enumerate(sorted(SECTORS.items(), key=lambda x: ends[x[0]])):
        # A lap grows over two frames, and its time shows on the row of the lap after it.
        before = SECTORS.get((car, lap - 1))
        for shown in (3, 5):
            body = {"STNR": f" {car}", "CLASSNAME": "SP9", "LAPS": lap, "TAGESZEIT": _clock(ends[car, lap]),
                    **{f"S{i + 1}TIME": _text(s[i]) for i in range(shown)}}
            if before:
                body["LASTLAPTIME"] = _text(sum(before))
            payload = json.dumps({"PID": "0", "EXPORTID": "R", "TRACKNAME": "Nordschleife", "RESULT": [body]})
            frames.append(("2026-03-14", "0", 2 * n + shown, "R", ends[car, lap] + shown, payload))
    for n, car in enumerate(("7", "9", "11")):
        # The third lap has begun: its row shows the time of the second.
        body = {"STNR": car, "CLASSNAME": "SP9", "LAPS": 3, "LASTLAPTIME": _text(sum(SECTORS[car, 2]))}
        payload = json.dumps({"PID": "0", "EXPORTID": "R", "TRACKNAME": "Nordschleife", "RESULT": [body]})
        frames.append(("2026-03-14", "0", 900 + n, "R", ends[car, 2] + 900, payload))
    schema = "event_date string, pid string, frame_no int, event string, received long, payload string"
    table = ingest.merge_latest_rows(feed.flatten_leaderboard(feed.frame_gate(spark.createDataFrame(frames, schema))))
    laps = live_laps.clean_live(live_laps.raw_laps(table))

    def positions(rows):
        found = timeline.class_position(timeline.boundaries(rows))
        return sorted((r.car, r.k, r.t, r.pos) for r in found.select("car", "k", "t", found.columns[-1]).toDF("car", "k", "t", "pos").collect())

    assert positions(laps) == positions(export) and len(positions(laps)) == 30


def test_pit_laps_are_flagged(spark):
    rows = spark.createDataFrame(
        [("R", "7", n, "SP9", *[None] * 10, 1, None, "d", "v") for n in (1, 2)],
        "event string, car string, lap int, klass string, "
        + ", ".join(f"s{i} long" for i in range(1, 6)) + ", " + ", ".join(f"v{i} long" for i in range(1, 6))
        + ", lap_end long, lap_time long, driver string, vehicle string",
    )
    pits = spark.createDataFrame([("R", "7", 2), ("R", "7", 2)], "event string, car string, lap int")
    assert {(r.lap, r.inpit) for r in live_laps.raw_laps(rows, pits).collect()} == {(1, False), (2, True)}


def test_events_are_replaced_whole(spark, tmp_path):
    def rows(*given):
        return spark.createDataFrame(given, "event_date string, driver string")

    path = str(tmp_path / "results")
    results.replace_event(rows(("2026-03-14", "a"), ("2026-03-14", "b"), ("2026-04-11", "c")), path)
    for _ in range(2):
        results.replace_event(rows(("2026-03-14", "d"), ("2026-06-20", "e")), path)
    stored = spark.read.schema("event_date string, driver string").parquet(path)
    assert sorted((r.event_date, r.driver) for r in stored.collect()) == [("2026-03-14", "d"), ("2026-04-11", "c"), ("2026-06-20", "e")]


def test_a_bundle_is_written_over_its_event_and_replays_clean(spark, tmp_path):
    def laps(rows):
        shape = (
            "event string, car string, klass string, lap bigint, s array<bigint>, spd array<bigint>,"
            " tend bigint, rt bigint, inpit boolean, driver string, vehicle string"
        )
        told = [(e, c, "SP9", n, s, [None] * 5, n * 500_000, rt, False, "d", "v") for e, c, n, s, rt in rows]
        return spark.createDataFrame(told, shape)

    shown = [
        ("R", "7", 1, [90_000, 90_000, 90_000, 90_000, None], None),
        # Shows the time of the first lap, which gives its last sector; a sector of its own is missing.
        ("R", "7", 2, [91_000, None, 91_000, 91_000, 91_000], 455_000),
        ("R", "7", 3, [2_000_000, None, None, None, None], 460_000),
        ("S", "7", 1, [1, 2, 3, 4, 5], 15),
    ]
    table = laps(shown)
    tyres = spark.createDataFrame([("7", "soft"), ("11", "hard")], "car string, state string")
    heads = spark.createDataFrame([("R", "NLS1"), ("S", "NLS2"), ("T", "NLS3")], "event string, slug string")
    bundle = archive.event_bundle({
        "meta": (archive.event_meta(heads, table), ["slug"]), "timing": (table, ["car", "lap"]),
        "tyre_state": (archive.for_each_event(tyres, ["R", "S"]), ["car"]),
    })
    path = str(tmp_path / "bundles")
    archive.write_bundle(bundle, path)
    archive.write_bundle(bundle.filter("event = 'R'"), path)
    stored = spark.read.parquet(path)
    cars = archive.unbundle(stored, "meta", "slug string, car_count bigint").collect()
    assert {(r.event, r.slug, r.car_count) for r in cars} == {("R", "NLS1", 1), ("S", "NLS2", 1), ("T", "NLS3", 0)}
    states = archive.unbundle(stored, "tyre_state", "car string, state string").collect()
    assert [(r.event, r.car) for r in sorted(states)] == [(e, c) for e in "RS" for c in ("11", "7")]
    clean = {(r.event, r.lap): (r.s, r.rt) for r in archive.unbundle_timing(stored).collect()}
    assert clean["R", 1] == ([90_000, 90_000, 90_000, 90_000, 95_000], 455_000)
    assert clean["R", 2] == ([91_000, 96_000, 91_000, 91_000, 91_000], 460_000)
    assert clean["R", 3][0][0] is None and clean["S", 1] == ([1, 2, 3, 4, 5], 15)
