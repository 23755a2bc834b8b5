"""Inputs that the given tables never hold: other encodings, blanks, letters, clocks and open laps."""

import json

from pyspark.sql import functions as F

from apexline.functions import texts
from apexline.operators import ingest, pits, results
from apexline.sources import frames as feed
from apexline.sources import pages, sector_csv, sheets

NBSP = " "


def _export(path, name, head, *rows):
    (path / name).write_bytes("\n".join([head, *rows, ""]).encode("cp1252"))


def test_windows_letters_and_a_header_of_its_own_for_each_file(spark, tmp_path):
    _export(tmp_path, "a.CSV", "STNR;RUNDE_NR;KLASSEKURZ;SEKTOR1_ZEIT;FAHRER_NR;FAHRER1_NAME", "7;1;SP9;86,2;1;Šíp Žižka €")
    _export(tmp_path, "b.CSV", "RUNDE_NR;STNR;SEKTOR1_ZEIT;FAHRER1_NAME;FAHRZEUG", "3;9;1:26.200;Åse Œuvre;BMW")
    rows = {r.car: r for r in sector_csv.read_sector_csv(spark, str(tmp_path)).collect()}
    assert (rows["7"].lap, rows["7"].klass, rows["7"].driver) == (1, "SP9", "Šíp Žižka €")
    assert (rows["9"].lap, rows["9"].driver, rows["9"].vehicle) == (3, "Åse Œuvre", "BMW")
    assert rows["9"].s[0] == 86_200 and rows["9"].klass is None
    files = sector_csv.read_rows(spark, str(tmp_path)).select("STNR", "file").collect()
    assert {(r.STNR, r.file) for r in files} == {("7", "a.CSV"), ("9", "b.CSV")}


def test_blanks(spark):
    row = spark.range(1).select(
        texts.stripped(F.lit(f"\t{NBSP} 7 ﻿")).alias("a"), texts.plain_blanks(F.lit(f"a{NBSP}b　c")).alias("b")
    ).first()
    assert (row.a, row.b) == ("7", "a b c")


def _frame(spark, **payload):
    row = ("2026-03-14", "0", 1, "e", 43_200_000, json.dumps({"PID": "0", "TRACKNAME": "Nordschleife", **payload}))
    return spark.createDataFrame([row], "event_date string, pid string, frame_no int, event string, received long, payload string")


def test_car_numbers_and_clocks_of_frames(spark):
    car = {"STNR": f"\t7{NBSP}", "LAPS": 3, "S1TIME": "86.2"}
    missing = feed.flatten_leaderboard(_frame(spark, RESULT=[car])).first()
    assert missing.car == "7" and missing.lap_end == 43_200_000
    unreadable = feed.flatten_leaderboard(_frame(spark, TOD="soon", RESULT=[car])).first()
    assert unreadable.lap_end is None
    assert feed.flatten_leaderboard(_frame(spark, RESULT=[{"STNR": NBSP, "LAPS": 1}])).count() == 0


def test_names_lose_every_mark(spark):
    names = ["Nguyễn Văn", "Йован", "Şahin", "ÅSE", "O’Neil"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(sheets.fold_key(F.col("n")).alias("k")).collect()
    assert [r.k for r in got] == ["nguyen van", "иован", "sahin", "ase", "o’neil"]


def test_sheet_heads_with_wide_blanks(spark):
    plain = "1 7 SP9 PRO BMW M4 GT3 28 4:01:02.345 8:12.345 x"
    corpus = spark.createDataFrame([("a", plain), ("b", plain.replace(" ", NBSP))], "event string, text string")
    got = {r.event: r for r in sheets.parse_result_sheets(corpus).drop("at").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].asDict() | {"event": ""} == got["b"].asDict() | {"event": ""}


def test_no_required_label_keeps_every_event(spark):
    rows = [("2026-03-14", "quali", "08:30", "10:00", 1), ("2026-04-11", "race", "12:00", "16:00", 1)]
    sessions = spark.createDataFrame(rows, "event_date string, label string, start string, `end` string, at int")
    assert results.session_windows(sessions, ()).count() == 2
    assert results.session_windows(sessions).count() == 1
    text = spark.createDataFrame([("s", f"Samstag, 14. März 2026 08:30{NBSP}Uhr NLS Training * ")], "source string, text string")
    found = pages.anchored_timetable(text, "NLS", {"training": "training"}, None, (), "2026")
    assert found.count() == 1


def test_the_lap_being_driven_is_no_pit_lap(spark):
    laps = [("e", "1", 1, [1, 1, 1, 1, None], None), ("e", "1", 2, [1, None, None, None, None], None), ("e", "2", 1, [1, 1, 1, 1, None], 9)]
    table = spark.createDataFrame(laps, "event string, car string, lap int, s array<long>, rt long")
    assert {(r.car, r.lap) for r in pits.pit_laps_no_last_sector(table).collect()} == {("1", 1), ("2", 1)}


def test_versions_of_one_instant_follow_their_frames(spark):
    rows = [("e", "1", 1, 5, n, s, None, None, None, None, None, None, False) for n, s in ((1, 10), (2, 11), (3, 11), (4, 10))]
    log = spark.createDataFrame(
        rows, "event string, car string, lap int, received long, frame_no int, s1 long, s2 long, s3 long, s4 long,"
        " s5 long, lap_time long, tend long, inpit boolean"
    )
    for split in (False, True):
        assert sorted(r.frame_no for r in ingest.changed_rows(log, split).collect()) == [1, 2, 4]
