"""Streaming queries: the given events as a stream of files out of time order, run until all are read."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from apexline.functions.session import cut, fresh_dir
from apexline.operators import live_laps, timeline
from apexline.plans.registry import part, parts_of, query, sql
from apexline.plans.timeline import cleaned_parts
from apexline.sources.standins import Timing, clock_text, day_text, hms_text, minutes_text, seconds_text
from apexline.sources.tables import table
from apexline.streaming import live

HALF_DAY = 43_200_000
GAP = 3_600_000
FILES = 5
# Rows of a file of the stream, about, from the size on where a batch is more than one file.
FILE_ROWS = 50_000

part(
    "streamed",
    f"""
SELECT event_id AS frame_no, 'E' || (user_id % 2) AS event, CAST(user_id AS VARCHAR) AS car,
  epoch_us(ts) // 1000 AS received, CASE WHEN event_type = 'error' THEN '3' ELSE '0' END AS pid, event_type,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents,
  strftime(ts, '%Y-%m-%d') AS event_date, epoch_us(ts) // 1000 // {HALF_DAY} - 39446 AS lap,
  epoch_us(ts) // 1000 // {4 * HALF_DAY} % 4 AS counter, strftime(ts, '%H:%M') || ':00' AS clock FROM events""",
)


def _arriving(given, key, rows):
    """Rows, about so many, as a stream of files, dealt by a hash of their key; a fifth of the files per batch."""
    spark = given.sparkSession
    path = fresh_dir(spark, "stream-events")
    # A file is read by one task, which makes whole frames of it: larger tables make more files, not larger ones.
    each = 1 + rows // (FILES * FILE_ROWS)
    file = F.pmod(F.xxhash64(key), F.lit(FILES * each)).cast("int")
    given.repartition(FILES * each, file).write.parquet(path)
    return spark.readStream.schema(given.schema).option("maxFilesPerTrigger", each).parquet(path)


def frame_stream(spark, folder):
    """One frame per event: a car object, or a message for errors.

    Events are dealt into files by a hash, so every batch reaches back behind the ones before it.
    """
    given = table(spark, folder, "events")
    events = _arriving(given, "event_id", given.count())
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    rows = events.select(
        F.concat(F.lit("E"), F.col("user_id") % 2).alias("event"),
        F.col("user_id").cast("string").alias("car"), F.col("event_id").alias("frame_no"),
        ms.alias("received"), "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    k, t = F.col("k"), F.col("received")
    note = F.col("event_type") == "error"
    time = seconds_text(F.col("cents") * 10)
    car = F.struct(
        F.col("car").alias("STNR"), F.expr(f"received div {HALF_DAY} - 39446").alias("LAPS"),
        *[F.when(k % 5 == i - 1, time).alias(f"S{i}TIME") for i in range(1, 6)],
        F.expr(f"received div {4 * HALF_DAY} % 4").alias("PITSTOPCOUNT"),
    )
    text = F.concat(F.lit("# "), k % 20, F.lit(" noted"))
    minute = F.concat(F.substring(hms_text(t), 1, 5), F.lit(":00"))
    message = F.struct(minute.alias("MESSAGETIME"), text.alias("MESSAGE"))
    pid = F.when(note, "3").otherwise("0")
    body = F.struct(
        pid.alias("PID"), F.col("event").alias("EXPORTID"), F.lit("Nordschleife").alias("TRACKNAME"),
        clock_text(t).alias("TOD"), F.when(~note, F.array(car)).alias("RESULT"),
        F.when(note, F.array(message)).alias("MESSAGES"),
    )
    return rows.select(
        day_text(t * 1000).alias("event_date"), pid.alias("pid"), "frame_no", "event", "received",
        F.to_json(body).alias("payload"),
    )


def _run(start, spark, folder, name, frames=None, **options):
    path = fresh_dir(spark, name)
    frames = frame_stream(spark, folder) if frames is None else frames
    stream = start(frames, path, f"{path}-progress", once=True, **options)
    stream.awaitTermination()
    return path


@query(
    "stream_timing",
    sql(
        """
SELECT event, car, lap, received, """
        + ", ".join(f"CASE WHEN k % 5 = {i - 1} THEN cents * 10 END AS s{i}" for i in range(1, 6))
        + """, received % 86400000 AS lap_end, counter
FROM streamed WHERE pid = '0' QUALIFY row_number() OVER (PARTITION BY event, car, lap
  ORDER BY received DESC, frame_no DESC) = 1""",
        "streamed",
    ),
)
def _(spark, folder):
    path = _run(live.stream_timing, spark, folder, "stream-timing")
    return live.read_timing(spark, path).select(
        "event", "car", "lap", "received", "s1", "s2", "s3", "s4", "s5", "lap_end", "counter"
    )


@query(
    "stream_pit_counter",
    sql(
        """
SELECT DISTINCT event, car, lap FROM (SELECT event, car, lap, counter,
  lag(counter) OVER (PARTITION BY event, car ORDER BY received, lap) AS before FROM streamed WHERE pid = '0')
WHERE counter > before""",
        "streamed",
    ),
)
def _(spark, folder):
    path = _run(live.stream_pit_counter, spark, folder, "stream-pits")
    return live.read_pit_laps(spark, path)


@query(
    "stream_messages",
    sql(
        """
SELECT DISTINCT event_date, CAST(k % 20 AS VARCHAR) AS car, '# ' || (k % 20) || ' noted' AS message,
  event_date || '|' || clock || '|# ' || (k % 20) || ' noted' AS ext_key FROM streamed WHERE pid = '3'""",
        "streamed",
    ),
)
def _(spark, folder):
    path = _run(live.stream_messages, spark, folder, "stream-messages")
    return live.read_messages(spark, path).select("event_date", "car", "message", "ext_key")


part(
    "greedy_stream",
    f"""
SELECT event_date, pid, min(received) AS received FROM streamed GROUP BY event_date, pid
UNION ALL SELECT g.event_date, g.pid, (SELECT min(f.received) FROM streamed f
  WHERE f.event_date = g.event_date AND f.pid = g.pid AND f.received >= g.received + {GAP}) AS received
FROM greedy_stream g WHERE g.received IS NOT NULL""",
    "streamed",
)


@query(
    "stream_frame_archive",
    sql("SELECT event_date, pid, received FROM greedy_stream WHERE received IS NOT NULL",
        "greedy_stream"),
)
def _(spark, folder):
    path = _run(live.stream_frame_archive, spark, folder, "stream-archive")
    return live.read_frame_archive(spark, path, min_ms=GAP).select("event_date", "pid", "received")


# ---- from frames to positions ----------------------------------------------------

# The race is told a hundred times as fast, so that its laps take minutes.
TICK_US = 100_000
DAY_MS = 86_400_000
SECTOR_CAP_MS, LAP_CAP_MS = 900_000, 3_600_000

part(
    "wire",
    f"""
SELECT *, now - since AS took, CASE WHEN k % 13 <> 0 THEN now - since END AS shown
FROM (SELECT *, t // {TICK_US} AS now, (t - dur) // {TICK_US} AS since FROM crossing)""",
    "crossing",
)
part(
    "wire_full",
    """
SELECT event, car, lap, CAST(sum(took) AS BIGINT) AS rt FROM wire GROUP BY event, car, lap HAVING count(*) = 5""",
    "wire",
)
part(
    "wire_pit",
    """
SELECT DISTINCT event, car, lap FROM (SELECT event, car, lap, counter,
  lag(counter) OVER (PARTITION BY event, car ORDER BY now, lap, event_id) AS before FROM wire WHERE counter IS NOT NULL)
WHERE counter > before""",
    "wire",
)
part(
    "wire_newest",
    "SELECT * FROM wire QUALIFY row_number() OVER (PARTITION BY event, car, lap ORDER BY now DESC, event_id DESC) = 1",
    "wire",
)
part(
    "wire_lap",
    "SELECT a.event, a.car, a.klass, a.lap, "
    + ", ".join(f"max(CASE WHEN b.sector = {i} THEN b.shown END) AS s{i}" for i in range(1, 6))
    + f""", a.now % {DAY_MS} AS tend, f.rt, p.lap IS NOT NULL AS inpit, a.event_type AS driver,
  'V' || (a.k % 3) AS vehicle, NULL::BIGINT AS v1
FROM wire_newest a JOIN wire b ON b.event = a.event AND b.car = a.car AND b.lap = a.lap AND b.sector <= a.sector
LEFT JOIN wire_full f ON f.event = a.event AND f.car = a.car AND f.lap = a.lap - 1
LEFT JOIN wire_pit p ON p.event = a.event AND p.car = a.car AND p.lap = a.lap
GROUP BY a.event, a.car, a.klass, a.lap, a.now, f.rt, p.lap, a.event_type, a.k""",
    "wire", "wire_newest", "wire_full", "wire_pit",
)
_CLEANED = cleaned_parts("wire", "wire_lap", SECTOR_CAP_MS, LAP_CAP_MS)
part(
    "wire_clean",
    f"SELECT {_CLEANED}, driver, vehicle, v1, {', '.join(f'v1 AS v{i}' for i in range(2, 6))},"
    " 'N' AS pit_status FROM wire_holes",
    "wire_holes",
)
parts_of("wire", "wire_clean", "fixed", ("sector_row", "leg"))
parts_of("wire", "wire_lap", "lap", ("dim",))
part(
    "wire_boundary",
    """
SELECT l.event, d.klass, l.car, l.lap, l.sector, l.t1 AS t,
  row_number() OVER (PARTITION BY l.event, l.car ORDER BY l.t1, l.lap, l.sector) AS k
FROM wire_leg l JOIN wire_dim d USING (event, car)""",
    "wire_leg", "wire_dim",
)
parts_of("wire", "wire_boundary", "boundary", ("chart",))


def race_frames(timing):
    """A frame per crossing: the car's lap so far, the time of the lap before, and its stop counter."""
    now, since = F.expr(f"t div {TICK_US}"), F.expr(f"(t - dur) div {TICK_US}")
    wire = timing.crossing.withColumns({"now": now, "took": now - since})
    wire = wire.withColumn("shown", F.when(F.col("k") % 13 != 0, F.col("took")))
    # At most five crossings a lap.
    lap = Window.partitionBy("event", "car", "lap")
    so_far = lap.orderBy("sector").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = wire.withColumns(
        {f"s{i}": F.max(F.when(F.col("sector") == i, F.col("shown"))).over(so_far) for i in range(1, 6)}
    )
    full = wire.groupBy("event", "car", (F.col("lap") + 1).alias("lap")).agg(
        F.when(F.count(F.lit(1)) == 5, F.sum("took")).alias("rt")
    )
    car = F.struct(
        F.col("car").alias("STNR"), F.col("klass").alias("CLASSNAME"), F.col("lap").alias("LAPS"),
        F.col("event_type").alias("NAME"), F.concat(F.lit("V"), F.col("k") % 3).alias("CAR"),
        *[seconds_text(F.col(f"s{i}")).alias(f"S{i}TIME") for i in range(1, 6)],
        minutes_text(F.col("rt")).alias("LASTLAPTIME"), clock_text(F.col("now")).alias("TAGESZEIT"),
        F.col("counter").alias("PITSTOPCOUNT"),
    )
    body = F.struct(
        F.lit("0").alias("PID"), F.col("event").alias("EXPORTID"), F.lit("Nordschleife").alias("TRACKNAME"),
        F.array(car).alias("RESULT"),
    )
    return grown.join(full, ["event", "car", "lap"], "left").select(
        day_text(F.col("now") * 1000).alias("event_date"), F.lit("0").alias("pid"),
        F.col("event_id").alias("frame_no"), "event", F.col("now").alias("received"),
        F.to_json(body).alias("payload"),
    )


@query(
    "live_class_position",
    sql(
        """
SELECT c.event, c.klass, c.car, c.k, c.lap, c.sector, c.t, c.position, l.inpit
FROM wire_chart c JOIN wire_lap l USING (event, car, lap)""",
        "wire_chart", "wire_lap",
    ),
)
def _(spark, folder):
    rows = table(spark, folder, "events").count()
    frames = _arriving(race_frames(Timing(spark, folder)), "frame_no", rows)
    rows = _run(live.stream_timing, spark, folder, "live-timing", frames)
    pits = _run(live.stream_pit_counter, spark, folder, "live-pits", frames)
    laps = cut(live_laps.clean_live(live_laps.raw_laps(live.read_timing(spark, rows), live.read_pit_laps(spark, pits))))
    found = timeline.class_position(timeline.boundaries(laps))
    return found.join(laps.select("event", "car", "lap", "inpit"), ["event", "car", "lap"])
