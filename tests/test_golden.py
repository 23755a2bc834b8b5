"""Worked examples with known results."""

from pyspark.sql import functions as F

from apexline.operators import pits
from apexline.sources import frames as feed
from apexline.sources import sector_csv, sheets

NOON = 43_200_000


def _frame(spark, body, received=1_784_023_200_000):
    return spark.createDataFrame(
        [("2026-07-14", "0", 1, received, body)],
        "event_date string, pid string, frame_no bigint, received bigint, payload string",
    )


def test_lap_with_all_sectors(spark):
    body = (
        '{"TRACKNAME":"Nürburgring","TOD":"12:00:00","NROFINTERMEDIATETIMES":5,"RESULT":[{"STNR":"941",'
        '"CLASSNAME":"SP9 PRO","LAPS":15,"LASTLAPTIME":"8:12.345","S1TIME":"86.2","S5TIME":"61.9"}]}'
    )
    (row,) = feed.flatten_leaderboard(_frame(spark, body)).collect()
    assert (row.car, row.lap, row.lap_end, row.lap_time) == ("941", 15, NOON, 492_345)
    assert (row.s1, row.s5) == (86_200, 61_900)


def test_lap_into_the_pits(spark):
    body = (
        '{"TOD":"12:00:00","RESULT":[{"STNR":"7","LAPS":22,"LASTLAPTIME":"","S1TIME":"85.0",'
        '"S2TIME":"89.9","S4TIME":"-","S5TIME":""}]}'
    )
    (row,) = feed.flatten_leaderboard(_frame(spark, body)).collect()
    assert (row.s1, row.s2, row.s3, row.s4, row.s5) == (85_000, 89_900, None, None, None)
    assert (row.lap_time, row.lap_end) == (None, NOON)


def test_tracks_at_the_gate(spark):
    tracks = ["Nürburgring", "24h Nordschleife", "Hockenheimring", ""]
    frames = spark.createDataFrame(
        [(i, "0", f'{{"TRACKNAME":"{t}","EXPORTID":"{i}"}}') for i, t in enumerate(tracks)],
        "frame_no bigint, pid string, payload string",
    )
    assert {r.frame_no for r in feed.frame_gate(frames).collect()} == {0, 1}
    assert {r.event for r in feed.rejected_events(frames).collect()} == {"2", "3"}


def test_three_sectors_only(spark):
    body = (
        '{"NROFINTERMEDIATETIMES":3,"TOD":"12:00:00","RESULT":[{"STNR":"1","LAPS":2,"S1TIME":"40",'
        '"S3TIME":"42","S4TIME":"99","S5TIME":"99"}]}'
    )
    (row,) = feed.flatten_leaderboard(_frame(spark, body)).collect()
    assert (row.s1, row.s3, row.s4, row.s5) == (40_000, 42_000, None, None)


def test_no_clock_falls_back_to_receipt(spark):
    body = '{"RESULT":[{"STNR":"5","LAPS":1,"S1TIME":"30"}]}'
    (row,) = feed.flatten_leaderboard(_frame(spark, body)).collect()
    assert row.lap_end == 1_784_023_200_000 % 86_400_000


def test_message_clock_is_berlin(spark):
    body = (
        '{"PID":"3","MESSAGES":[{"MESSAGETIME":"9:05:00","MESSAGE":" # 12 slow "},'
        '{"MESSAGETIME":"soon","MESSAGE":"x"},{"MESSAGETIME":"10:00:00","MESSAGE":" "}]}'
    )
    rows = feed.map_messages(_frame(spark, body)).orderBy("at").collect()
    assert [(r.car, r.message) for r in rows] == [("12", "# 12 slow"), (None, "x")]
    # July: two hours ahead of UTC.
    assert rows[0].created % 86_400_000 == (7 * 60 + 5) * 60_000
    assert rows[1].created is None
    assert rows[0].ext_key == "2026-07-14|9:05:00|# 12 slow"


def test_four_stops(spark):
    """Four stops of one car: minima 138, 93, 167, 50 and 81.393 s given away."""
    ms = 1000
    end = 57_600 * ms
    laps = spark.createDataFrame(
        [("e", "665", "K", n, "d") for n in range(1, 26)],
        "event string, car string, klass string, lap bigint, driver string",
    )
    stopped = {5: 144_173, 8: 139_564, 15: 185_636, 21: 60_020}
    stops = spark.createDataFrame([("e", "665", n) for n in stopped], "event string, car string, lap bigint")
    stints = pits.stints(laps, stops, False).filter("stopped")
    anchors = {5: end - 180 * 60 * ms, 8: end - 150 * 60 * ms, 15: end - 90 * 60 * ms,
               21: end - 11 * 60 * ms + 30 * ms}
    known = spark.createDataFrame(
        [("e", "665", n, anchors[n], end, float(stopped[n]), True) for n in stopped],
        "event string, car string, lap bigint, anchor bigint, race_end bigint, stopped double,"
        " is_real boolean",
    )
    rows = stints.select(
        "event", "car", F.col("last_lap").alias("lap"), F.col("stint").alias("stop"), "laps"
    ).join(known, ["event", "car", "lap"]).withColumn("klass", F.lit("K"))
    last_hour = spark.createDataFrame([(1, 28), (11, 50), (33, 99), (59, 158)], "minutes bigint, seconds bigint")
    margins = pits.stop_margin(pits.minimum_stop(rows, last_hour, ms), ms)
    got = [
        (r.laps, r.minimum, r.table, round(r.margin)) for r in margins.orderBy("lap").collect()
    ]
    assert got == [
        (5, 138, "A", 6_173), (3, 93, "B", 46_564), (7, 167, "B", 18_636), (6, 50, "C", 10_020),
    ]
    (total,) = pits.margin_totals(margins, ms).collect()
    assert (total.given_away, total.floor, total.stopped) == (81_393.0, 448_000, 529_393.0)


def test_long_stops_are_repairs(spark):
    rows = spark.createDataFrame(
        [("e", "k", "1", 700_000.0, 100, True), ("e", "k", "1", 110_000.0, 100, True)],
        "event string, klass string, car string, stopped double, minimum bigint, is_real boolean",
    )
    (total,) = pits.margin_totals(pits.stop_margin(rows, 1000), 1000).collect()
    assert (total.stops, total.repairs, total.given_away) == (1, 1, 10_000.0)


def test_sector_export_in_latin_text(spark, tmp_path):
    names = list(sector_csv.COLUMNS) + ["EXTRA"]
    row = dict.fromkeys(names, "")
    row.update(
        STNR="12", RUNDE_NR="3", KLASSEKURZ="SP9 PRO-", TAGESZEIT="12:08:32.610",
        RUNDENZEIT_IN_SEKUNDEN="492,771", SEKTOR1_ZEIT="1:11.243", SEKTOR2_ZEIT="49.898",
        SEKTOR1_KMH="178,25", INPIT="J", PITIN_TIME="12:08:20.000", PITSTOPDURATION="00.000",
        DIESCHNELLSTE="J", FAHRER_NR="2", FAHRER1_NAME="Groß", FAHRER2_NAME="Müller",
        FAHRZEUG="Porsche",
    )
    empty = dict(row, RUNDE_NR="4", SEKTOR1_ZEIT="", SEKTOR2_ZEIT="-")
    lines = [";".join(names)] + [";".join(r[n] for n in names) for r in (row, empty)]
    path = tmp_path / "sectors.CSV"
    path.write_bytes("\n".join(lines).encode("cp1252"))
    (lap,) = sector_csv.read_sector_csv(spark, str(path)).collect()
    assert (lap.car, lap.lap, lap.klass, lap.driver) == ("12", 3, "SP9 PRO-", "Müller")
    assert lap.s == [71_243, 49_898, None, None, None]
    assert (lap.tend, lap.rt) == (43_712_610, 492_771)
    assert (lap.pit_in, lap.pit_dur, lap.inpit, lap.fastest) == (43_700_000, None, True, True)
    assert lap.spd[0] == 17_825


def test_driver_keys_fold(spark):
    df = spark.createDataFrame([("Müller  D'Árcy, Jr.*",), ("Şimşek Žan",)], "n string")
    assert [r[0] for r in df.select(sheets.fold_key(F.col("n"))).collect()] == [
        "muller darcy jr", "simsek zan",
    ]


def test_driver_zone(spark):
    zone = "Team 7 Groß Max, Köln DMSB-1 12 PRO Rast Rene, Schweiz CH-77 *DSQ Smith Bob, Irland"
    cars = spark.createDataFrame([("e", 1, zone)], "event string, at int, zone string")
    got = sheets.explode_drivers(cars).orderBy("driver_no").collect()
    assert [(r.driver_name, r.place, r.license_no, r.nationality) for r in got] == [
        ("Groß Max", "Köln", "DMSB-1 12", "DE"), ("Rast Rene", "Schweiz", "CH-77", "CH"),
        ("Smith Bob", "Irland", None, "IE"),
    ]
