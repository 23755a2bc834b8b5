"""Ingest and cleaning queries."""

from pyspark.sql import functions as F

from apexline.functions.session import fresh_dir
from apexline.operators import ingest, sampling
from apexline.plans import parts  # noqa: F401
from apexline.plans.registry import part, query, sql
from apexline.plans.timeline import LONGEST_SECTOR
from apexline.sources import frames as feed
from apexline.sources import sector_csv
from apexline.sources.standins import (
    DAY, HOUR, Frames, Timing, clock_text, day_text, minutes_text, seconds_text,
)

# ---- sector export ---------------------------------------------------------


def sector_export(timing: Timing) -> str:
    """Laps written as export files; gives their folder."""
    laps = timing.lap
    ms = F.transform("s", lambda x: F.call_function("div", x, F.lit(1000)))
    named = laps.withColumns(
        {"ms": ms, "end_ms": F.expr("tend div 1000"), "rt_ms": F.expr("rt div 1000")}
    )

    def german(x):
        return F.replace(seconds_text(x), F.lit("."), F.lit(","))

    def sector(i):
        v = F.col("ms")[i]
        return F.coalesce(F.when(F.col("lap") % 2 == 0, minutes_text(v)).otherwise(seconds_text(v)),
                          F.lit(""))

    values = {
        "STNR": F.concat(F.lit(" "), "car"),
        "RUNDE_NR": F.col("lap").cast("string"),
        "KLASSEKURZ": F.col("klass"),
        "TAGESZEIT": clock_text(F.col("end_ms")),
        "RUNDENZEIT_IN_SEKUNDEN": F.when(F.col("k5") % 9 == 0, "").otherwise(german(F.col("rt_ms"))),
        **{f"SEKTOR{i}_ZEIT": sector(i - 1) for i in range(1, 6)},
        **{f"SEKTOR{i}_KMH": F.replace((F.col("spd")[i - 1] / 100).cast("string"), F.lit("."),
                                       F.lit(",")) for i in range(1, 6)},
        "INPIT": F.when(F.col("inpit"), "J").otherwise("N"),
        "PITIN_TIME": F.coalesce(clock_text(F.expr("pit_in div 1000")), F.lit("00.000")),
        "PITSTOPDURATION": F.coalesce(minutes_text(F.expr("pit_dur div 1000")), F.lit("")),
        "DIESCHNELLSTE": F.when(F.col("k5") % 10 == 0, "J").otherwise(""),
        "FAHRER_NR": (F.col("k5") % 4 + 1).cast("string"),
        "FAHRER1_NAME": F.concat(F.col("driver"), F.lit(" A")),
        "FAHRER2_NAME": F.concat(F.col("driver"), F.lit(" B ")),
        "FAHRER3_NAME": F.lit(" "),
        **{f"FAHRER{i}_NAME": F.lit("") for i in range(4, 9)},
        "FAHRZEUG": F.col("vehicle"),
    }
    path = fresh_dir(timing.spark, "sector-export")
    rows = named.select(*[values[c].alias(c) for c in sector_csv.COLUMNS])
    rows.write.csv(path, sep=";", encoding="ISO-8859-1", header=True)
    return path


@query(
    "read_sector_csv",
    sql(
        """
SELECT car, lap, klass, s1 // 1000 AS s1, s2 // 1000 AS s2, s3 // 1000 AS s3, s4 // 1000 AS s4,
  s5 // 1000 AS s5, v1, (tend // 1000) % 86400000 AS tend, CASE WHEN k5 % 9 <> 0 THEN rt // 1000 END AS rt,
  inpit, (pit_in // 1000) % 86400000 AS pit_in, pit_dur // 1000 AS pit_dur, k5 % 10 = 0 AS fastest, vehicle
FROM lap WHERE coalesce(s1, s2, s3, s4, s5) IS NOT NULL""",
        "lap",
    ),
)
def _(spark, folder):
    laps = sector_csv.read_sector_csv(spark, sector_export(Timing(spark, folder)))
    return laps.select(
        "car", "lap", "klass", *[F.col("s")[i].alias(f"s{i + 1}") for i in range(5)],
        F.col("spd")[0].alias("v1"), "tend", "rt", "inpit", "pit_in", "pit_dur", "fastest",
        "vehicle",
    )


@query(
    "active_driver",
    sql(
        "SELECT car, lap, driver || CASE k5 % 4 WHEN 1 THEN ' B' ELSE ' A' END AS driver FROM lap",
        "lap",
    ),
)
def _(spark, folder):
    rows = sector_csv.active_driver(
        sector_csv.read_rows(spark, sector_export(Timing(spark, folder)))
    )
    return rows.select(
        F.trim("STNR").alias("car"), F.col("RUNDE_NR").cast("bigint").alias("lap"), "driver"
    )


# ---- frames ----------------------------------------------------------------

part(
    "shot",
    """
SELECT *, event_id // 20 AS frame_no, reading // 1000 AS ms, t // 1000 AS t_ms FROM crossing""",
    "crossing",
)
part(
    "frame",
    """
SELECT *, CASE WHEN frame_no % 7 = 0 THEN 'LTS_TIMESYNC' WHEN frame_no % 7 = 3 THEN '3'
  WHEN frame_no % 7 = 5 THEN '4' ELSE '0' END AS pid,
  event || '-' || (frame_no % 5) AS export_id,
  CAST(DATE '1970-01-01' + CAST(received // 86400000 AS INTEGER) AS VARCHAR) AS event_date
FROM (SELECT event, frame_no, max(t) // 1000 + 500 AS received FROM shot GROUP BY event, frame_no)""",
    "shot",
)
part("board", "SELECT * FROM frame WHERE pid IN ('0', '4')", "frame")
part(
    "frame_log",
    """
SELECT event, frame_no, pid, received + later AS received,
  CAST(DATE '1970-01-01' + CAST((received + later) // 86400000 AS INTEGER) AS VARCHAR) AS event_date
FROM frame, (SELECT 0 AS later UNION ALL SELECT 1000) WHERE later = 0 OR frame_no % 4 = 0""",
    "frame",
)
part(
    "car_row",
    """
SELECT f.event_date, f.received, f.frame_no, f.export_id AS event, s.car, s.lap, s.klass,
  """
    + ", ".join(
        f"CASE WHEN s.sector = {i} AND ({i} <= 3 OR f.frame_no % 3 <> 0) THEN s.ms END AS s{i}"
        for i in range(1, 6)
    )
    + ", "
    + ", ".join(
        f"CASE WHEN s.sector = {i} AND ({i} <= 3 OR f.frame_no % 3 <> 0) THEN s.cents END AS v{i}"
        for i in range(1, 6)
    )
    + """,
  CASE WHEN s.k % 4 IN (0, 1) THEN s.t_ms % 86400000 ELSE f.received % 86400000 END AS lap_end,
  CASE WHEN s.sector = 5 THEN s.ms END AS lap_time, s.event_type AS driver, 'V' || (s.k % 3) AS vehicle,
  s.counter
FROM board f JOIN shot s USING (event, frame_no) WHERE s.k % 97 <> 0 AND s.k % 89 <> 0""",
    "board", "shot",
)


@query("flatten_leaderboard", sql("SELECT * FROM car_row", "car_row"))
def _(spark, folder):
    return feed.flatten_leaderboard(Frames(Timing(spark, folder)).once).drop("at")


@query(
    "frame_gate",
    sql(
        "SELECT event_date, event, frame_no, pid, received FROM frame"
        " WHERE pid <> 'LTS_TIMESYNC' AND frame_no % 5 IN (0, 1)",
        "frame",
    ),
)
def _(spark, folder):
    return feed.frame_gate(Frames(Timing(spark, folder)).once).drop("payload")


@query(
    "frame_gate_rejected",
    sql(
        "SELECT DISTINCT export_id AS event FROM frame"
        " WHERE pid <> 'LTS_TIMESYNC' AND frame_no % 5 NOT IN (0, 1)",
        "frame",
    ),
)
def _(spark, folder):
    return feed.rejected_events(Frames(Timing(spark, folder)).once)


def _objects(timing: Timing):
    """Laps as the two object shapes, by parity of the last sector's reading."""
    laps = timing.lap.withColumn("event_date", day_text(F.col("tend")))
    sec = F.transform("s", lambda x: seconds_text(F.call_function("div", x, F.lit(1000))))
    end_ms = F.expr("tend div 1000")
    first = F.struct(
        F.col("car").alias("stnr"), "lap", F.col("klass").alias("className"),
        *[sec[i].alias(f"s{i + 1}Time") for i in range(5)],
        F.when(F.col("k5") % 4 == 0, end_ms).alias("todTs"),
        F.when(F.col("k5") % 4 != 0, end_ms).alias("createdAt"),
        minutes_text(F.expr("rt div 1000")).alias("lapTime"),
        F.col("driver").alias("driverName"), F.col("vehicle").alias("car"),
    )
    other = F.col("k5") % 3 == 0
    second = F.struct(
        F.when(other, F.col("car")).alias("number"), F.when(~other, F.col("car")).alias("no"),
        F.when(other, F.col("lap")).alias("laps"), F.when(~other, F.col("lap")).alias("lapNumber"),
        F.col("klass").alias("class"), sec.alias("sectorTimes"),
        clock_text(end_ms).alias("lastCrossing"), F.expr("rt div 1000 / 1000").alias("lastLap"),
        F.col("inpit").alias("pit"), F.when(other, F.col("k5") % 7 == 1).alias("fastest"),
        F.when(~other, F.col("k5") % 5 == 1).alias("isFastest"), F.col("driver").alias("driver"),
        F.col("vehicle").alias("vehicle"),
    )
    snapshots = laps.filter("k5 % 2 = 0").select("event_date", F.to_json(first).alias("payload"))
    listed = F.struct(F.array(second).alias("results"))
    entries = laps.filter("k5 % 2 = 1").select(
        "event_date", F.to_json(listed, {"ignoreNullFields": "false"}).alias("payload")
    )
    return snapshots, entries


@query(
    "map_lap_objects",
    sql(
        """
SELECT CAST(DATE '1970-01-01' + CAST(tend // 86400000000 AS INTEGER) AS VARCHAR) AS event_date, car, lap,
  klass, s1 // 1000 AS s1, s2 // 1000 AS s2, s3 // 1000 AS s3, s4 // 1000 AS s4, s5 // 1000 AS s5,
  (tend // 1000) % 86400000 AS lap_end, rt // 1000 AS lap_time, inpit AND k5 % 2 = 1 AS inpit,
  k5 % 2 = 1 AND CASE WHEN k5 % 3 = 0 THEN k5 % 7 = 1 ELSE k5 % 5 = 1 END AS fastest, driver, vehicle
FROM lap""",
        "lap",
    ),
)
def _(spark, folder):
    return feed.map_lap_objects(*_objects(Timing(spark, folder)))


part(
    "greedy",
    """
SELECT event_date, pid, min(received) AS received FROM frame_log GROUP BY event_date, pid
UNION ALL
SELECT g.event_date, g.pid, (SELECT min(f.received) FROM frame_log f WHERE f.event_date = g.event_date
  AND f.pid = g.pid AND f.received >= g.received + 7200000) AS received
FROM greedy g WHERE g.received IS NOT NULL""",
    "frame_log",
)


@query(
    "sample_frames",
    sql(
        """
SELECT event_date, pid, received, min(frame_no) AS frame_no
FROM greedy JOIN frame_log USING (event_date, pid, received) GROUP BY event_date, pid, received""",
        "greedy",
    ),
)
def _(spark, folder):
    frames = Frames(Timing(spark, folder)).log
    kept = sampling.sample_frames(frames, 7_200_000)
    return kept.select("event_date", "pid", "received", "frame_no")


@query(
    "dedup_frames",
    sql(
        "SELECT event_date, pid, event, frame_no, min(received) AS received FROM frame_log"
        " WHERE pid <> 'LTS_TIMESYNC' GROUP BY event_date, pid, event, frame_no",
        "frame_log",
    ),
)
def _(spark, folder):
    frames = Frames(Timing(spark, folder)).log.filter("pid <> 'LTS_TIMESYNC'")
    return ingest.dedup_frames(frames).drop("payload", "body_hash")


@query(
    "payload_keys",
    sql(
        """
SELECT key, count(*) AS frames FROM (
  SELECT DISTINCT b.event, b.frame_no, unnest(CASE WHEN s.sector = 5 THEN ['S5TIME', 'LASTLAPTIME']
    ELSE ['S' || s.sector || 'TIME'] END) AS key
  FROM board b JOIN shot s USING (event, frame_no)) GROUP BY key""",
        "board", "shot",
    ),
)
def _(spark, folder):
    return feed.payload_keys(Frames(Timing(spark, folder)).once, "%time")


part(
    "message",
    """
SELECT f.event_date, f.received, f.frame_no, s.car, '# ' || s.car || ' ' || s.event_type AS message,
  CASE WHEN s.k % 17 <> 0 THEN strftime(make_timestamp(s.t), '%H:%M:%S') ELSE '--' END AS clock,
  CASE WHEN s.k % 17 <> 0 THEN (s.t_ms % 86400000) // 1000 * 1000
    + epoch_ms(CAST(f.event_date AS DATE)) - 3600000 END AS created,
  s.event_id
FROM frame_log f JOIN shot s USING (event, frame_no) WHERE f.pid = '3' AND s.k % 19 <> 0""",
    "frame_log", "shot",
)


@query(
    "map_messages",
    sql(
        "SELECT event_date, received, frame_no, car, message, created,"
        " event_date || '|' || clock || '|' || message AS ext_key FROM message",
        "message",
    ),
)
def _(spark, folder):
    return feed.map_messages(Frames(Timing(spark, folder)).log).drop("at")


@query(
    "merge_messages",
    sql(
        """
SELECT ext_key, arg_min(created, received) AS created, min(received) AS received
FROM (SELECT *, CASE WHEN clock <> '--' THEN event_date || '|' || clock || '|' || message END AS ext_key
      FROM message) WHERE ext_key IS NOT NULL GROUP BY ext_key
UNION ALL SELECT NULL, NULL, received FROM message WHERE clock = '--'""",
        "message",
    ),
)
def _(spark, folder):
    messages = feed.map_messages(Frames(Timing(spark, folder)).log)
    # A message without a readable clock has no key of its own here.
    keyed = messages.withColumn("ext_key", F.when(F.col("created").isNotNull(), F.col("ext_key")))
    return ingest.merge_messages(keyed).select("ext_key", "created", "received")


@query(
    "live_status",
    sql(
        """
SELECT event_date, export_id AS event_id, 'S' || (frame_no % 3) AS session, 'H' || (frame_no % 2) AS heat,
  CASE frame_no % 5 WHEN 0 THEN 'Nürburgring' WHEN 1 THEN '24h Nordschleife' WHEN 2 THEN 'Hockenheimring'
    WHEN 3 THEN '' ELSE 'NUERBURGRING' END AS track,
  (SELECT count(DISTINCT (c.event, c.car, c.lap)) FROM car_row c WHERE c.event_date = b.event_date) AS cars, received AS updated, true AS live
FROM board b QUALIFY row_number() OVER (PARTITION BY event_date
  ORDER BY received DESC, frame_no DESC, event DESC) = 1""",
        "board", "car_row",
    ),
)
def _(spark, folder):
    frames = Frames(Timing(spark, folder)).once
    rows = feed.flatten_leaderboard(frames).select("event_date", "event", "car", "lap").distinct()
    return feed.live_status(frames, rows)


_NOW = 1_706_659_200_000  # 2024-01-31


@query(
    "prune_frames",
    sql(
        f"""
SELECT event_date, pid, event, frame_no, received FROM frame_log
WHERE NOT (received < {_NOW} - 10 * 86400000 AND (received // 86400000) % 2 = 0)""",
        "frame_log",
    ),
)
def _(spark, folder):
    frames = Frames(Timing(spark, folder)).log
    archived = frames.filter(F.expr(f"received div {DAY // 1000} % 2 = 0")).select("event_date")
    kept, _gone = ingest.prune_frames(frames, archived, _NOW, 10)
    return kept.drop("payload")


# ---- row log and lap repairs -----------------------------------------------

part(
    "version",
    """
SELECT a.event, a.car, a.klass, a.lap, a.t AS tend, a.k, a.counter, """
    + ", ".join(f"max(CASE WHEN b.sector = {i} THEN b.reading END) AS s{i}" for i in range(1, 6))
    + """,
  CASE WHEN a.sector = 5 THEN CAST(sum(b.dur) AS BIGINT) END AS lap_time,
  count(*) FILTER (b.event_type = 'error') >= 2 AS inpit
FROM crossing a JOIN crossing b ON a.event = b.event AND a.car = b.car AND a.lap = b.lap AND b.sector <= a.sector
GROUP BY a.event, a.car, a.klass, a.lap, a.t, a.k, a.counter, a.sector""",
    "crossing",
)
part(
    "snapshot",
    """
SELECT event, car, klass, lap, s1, s2, s3, s4, s5, lap_time, tend, inpit, counter, tend + again AS received
FROM version, (SELECT 0 AS again UNION ALL SELECT 1) WHERE again = 0 OR k % 3 = 0""",
    "version",
)


@query(
    "merge_latest_rows",
    sql(
        "SELECT * FROM snapshot QUALIFY row_number() OVER"
        " (PARTITION BY event, car, lap ORDER BY received DESC) = 1",
        "snapshot",
    ),
)
def _(spark, folder):
    return ingest.merge_latest_rows(Timing(spark, folder).snapshots)


@query(
    "changed_rows",
    sql(
        """
SELECT * FROM snapshot WINDOW w AS (PARTITION BY event, car, lap ORDER BY received)
QUALIFY row_number() OVER w = 1 OR (s1, s2, s3, s4, s5, lap_time, tend, inpit)
  IS DISTINCT FROM lag((s1, s2, s3, s4, s5, lap_time, tend, inpit)) OVER w""",
        "snapshot",
    ),
)
def _(spark, folder):
    # A lap row has at most ten versions here.
    return ingest.changed_rows(Timing(spark, folder).snapshots, hot=False)


@query(
    "pit_from_counter",
    sql(
        """
SELECT DISTINCT event, car, lap FROM (
  SELECT event, car, lap, counter, lag(counter) OVER (PARTITION BY event, car ORDER BY received, lap) AS before
  FROM snapshot WHERE counter IS NOT NULL) WHERE counter > before""",
        "snapshot",
    ),
)
def _(spark, folder):
    timing = Timing(spark, folder)
    return ingest.pit_from_counter(timing.snapshots, timing.hot_car)


def _wide(laps, *cols):
    return laps.select(
        "event", "car", "lap", *[F.col("s")[i].alias(f"s{i + 1}") for i in range(5)], *cols
    )


_CAP, _LAP_CAP = 18 * HOUR, 60 * HOUR


@query(
    "null_implausible",
    sql(
        "SELECT event, car, lap, "
        + ", ".join(f"CASE WHEN s{i} <= {_CAP} THEN s{i} END AS s{i}" for i in range(1, 6))
        + f", CASE WHEN rt <= {_LAP_CAP} THEN rt END AS rt FROM lap",
        "lap",
    ),
)
def _(spark, folder):
    return _wide(ingest.null_implausible(Timing(spark, folder).lap, _CAP, _LAP_CAP), "rt")


part(
    "feed_lap",
    """
SELECT a.event, a.car, a.lap, a.s1, a.s2, a.s3, a.s4, CASE WHEN a.k5 % 2 <> 0 THEN a.s5 END AS s5, b.rt
FROM lap a LEFT JOIN lap b ON b.event = a.event AND b.car = a.car AND b.lap = a.lap - 1""",
    "lap",
)


@query(
    "shift_lap_time",
    sql(
        """
SELECT a.event, a.car, a.lap, CASE WHEN b.car IS NULL THEN a.rt ELSE b.rt END AS rt
FROM feed_lap a LEFT JOIN feed_lap b ON b.event = a.event AND b.car = a.car AND b.lap = a.lap + 1""",
        "feed_lap",
    ),
)
def _(spark, folder):
    laps = ingest.shift_lap_time(Timing(spark, folder).feed_lap)
    return laps.select("event", "car", "lap", "rt")


@query(
    "backfill_last_sector",
    sql(
        """
SELECT a.event, a.car, a.lap, a.s1, a.s2, a.s3, a.s4,
  coalesce(a.s5, b.rt - (a.s1 + a.s2 + a.s3 + a.s4)) AS s5
FROM feed_lap a LEFT JOIN feed_lap b ON b.event = a.event AND b.car = a.car AND b.lap = a.lap + 1""",
        "feed_lap",
    ),
)
def _(spark, folder):
    return _wide(ingest.backfill_last_sector(Timing(spark, folder).feed_lap))


@query("repair_dropped_sector", sql("SELECT event, car, lap, s1, s2, s3, s4, s5 FROM fixed", "fixed"))
def _(spark, folder):
    return _wide(ingest.repair_dropped_sector(Timing(spark, folder).lap, LONGEST_SECTOR))
