"""What a stream pays for each key: state by buckets, and files by days."""

import glob

from pyspark.sql import functions as F
from test_streams import _feed, _run, _shown

from apexline.streaming import live


def test_keys_share_their_state(spark, tmp_path):
    """900 laps are held in at most BUCKETS groups, and a later batch still meets them."""
    first = [_shown(n, str(n % 30), n // 30, 1000 + n, "1:00", PITSTOPCOUNT=0) for n in range(900)]
    again = [_shown(n + 900, str(n % 30), n // 30, 5000 + n, "1:00", PITSTOPCOUNT=0) for n in range(900)]
    _feed(spark, str(tmp_path / "in"), [first, again])
    path = str(tmp_path / "out")
    stream = live.stream_timing(live.read_frames(spark, str(tmp_path / "in"), 1), path, f"{path}-check", once=True)
    stream.awaitTermination()
    held = stream.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert 0 < held <= live.BUCKETS
    got = live.read_timing(spark, path)
    assert got.count() == 900 and got.agg(F.min("received")).first()[0] == 5000
    # Of the second batch only the times are told.
    stored = spark.read.parquet(f"{path}/rows")
    assert stored.filter("again").count() == 900 == stored.filter("not again").count()


def test_a_batch_writes_a_file_a_day(spark, tmp_path):
    shown = [_shown(n, str(n), 1, 1000 + n, "1:00") for n in range(200)]
    _feed(spark, str(tmp_path / "in"), [shown])
    path = _run(live.stream_timing, spark, (str(tmp_path / "in"),), tmp_path)
    assert len(glob.glob(f"{path}/rows/event_date=*/batch=*/*.parquet")) == 1
