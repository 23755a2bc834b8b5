"""What large tables need: work that is not done for nothing, rows and files that stay small."""

from conftest import SMALL
from pyspark.sql import functions as F

from apexline.functions import times
from apexline.operators import archive as bundles
from apexline.plans import QUERIES, archive, streams
from apexline.sources import sheets


def test_car_count_splits_no_other_kind(spark, hot, monkeypatch):
    told, made = [], bundles.event_bundle
    monkeypatch.setattr(archive.archive, "event_bundle", lambda kinds, *a, **b: told.extend(kinds) or made(kinds, *a, **b))
    assert QUERIES["event_car_count"](spark, SMALL).count() == 2
    assert told == ["meta"]
    told.clear()
    archive._bundle(spark, SMALL)
    assert len(told) == len(set(told)) == 11


def test_drivers_are_read_without_a_shuffle(spark):
    zone = "B:Team X AB12 Mo Hans, Bad Ems DE-12 &5 *x PRO/AM, S. Li O'Neil, NL-7 Zoë, Köln, XX-1 P.R.O. Ann*, *DSQ"
    cars = spark.createDataFrame([("a", 1, zone), ("a", 1, "Al, Ulm 7"), ("b", 1, None), (None, 2, "Al, ")], "event string, at int, zone string")
    got = sheets.explode_drivers(cars)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = [(r.event, r.driver_no, r.driver_name, r.place, r.license_no) for r in got.collect()]
    # Equal heads of two sheets are cars of their own.
    assert sorted(rows, key=str) == sorted([
        ("a", 1, "Mo Hans", "Bad Ems", "DE-12 &5 *x"), ("a", 2, "Zoë", "Köln", None), ("a", 3, "Ann", "", None),
        ("a", 1, "Al", "Ulm", "7"), (None, 1, "Al", "", None),
    ], key=str)


def test_lap_text_takes_its_text_once(spark):
    texts = ["8:56.212", "4:01:02.345", "100:1:02.345", "x 123:04:05.678 y", "0:00.000", "", None, "1:2.345"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(times.lap_text_ms(F.col("t")).alias("ms"))
    assert [r.ms for r in df.collect()] == [536_212, 14_462_345, 360_062_345, 443_045_678, None, None, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1


def test_larger_tables_make_more_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    given = spark.range(4_000)
    frames = streams._arriving(given, "id", 4_000)
    held = spark.read.parquet(frames._jdf.queryExecution().analyzed().toString().split("FileSource[")[1].split("]")[0])
    sizes = [r["count"] for r in held.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 4_000 and len(sizes) > streams.FILES and max(sizes) < 1_000
