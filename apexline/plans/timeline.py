"""Timeline queries."""

from pyspark.sql import functions as F

from apexline.operators import ingest, live_laps, timeline
from apexline.plans import parts  # noqa: F401
from apexline.plans.registry import part, query, sql
from apexline.sources.standins import HOUR, Timing

# The stand-in's crossings lie hours apart, so its limits are wider than a race's.
LONGEST_SECTOR = 72 * HOUR


def clean(timing: Timing):
    return ingest.repair_dropped_sector(timing.lap, LONGEST_SECTOR)


def positions(timing: Timing):
    bounds = timeline.boundaries(clean(timing), timing.hot_car)
    return timeline.class_position(bounds, timing.hot_class)


@query("legs", sql("SELECT event, car, lap, sector, t0, t1, speed FROM leg", "leg"))
def _(spark, folder):
    return timeline.legs(clean(Timing(spark, folder)))


@query("boundaries", sql("SELECT event, klass, car, lap, sector, t, k FROM boundary", "boundary"))
def _(spark, folder):
    timing = Timing(spark, folder)
    return timeline.boundaries(clean(timing), timing.hot_car).drop("t_next")


@query("sector_times", sql("SELECT event, car, lap, s1, s2, s3, s4, s5 FROM fixed", "fixed"))
def _(spark, folder):
    return timeline.sector_times(clean(Timing(spark, folder)))


@query(
    "pit_laps",
    sql(
        "SELECT event, car, lap, row_number() OVER (PARTITION BY event, car ORDER BY lap) AS stop,"
        " count(*) OVER (PARTITION BY event, car) AS stops FROM lap WHERE inpit",
        "lap",
    ),
)
def _(spark, folder):
    timing = Timing(spark, folder)
    return timeline.pit_laps(timing.lap, timing.hot_car)


@query(
    "pit_windows",
    sql(
        "SELECT event, car, lap, pit_in, pit_dur, pit_in + pit_dur AS pit_out FROM lap"
        " WHERE inpit AND (pit_in IS NOT NULL OR pit_dur IS NOT NULL)",
        "lap",
    ),
)
def _(spark, folder):
    return timeline.pit_windows(Timing(spark, folder).lap)


@query(
    "driver_by_lap",
    sql(
        "SELECT event, car, lap, driver,"
        " first_value(driver) OVER (PARTITION BY event, car ORDER BY lap) AS name FROM lap",
        "lap",
    ),
)
def _(spark, folder):
    return timeline.driver_by_lap(Timing(spark, folder).lap)


@query("car_dim", sql("SELECT event, car, klass, vehicle FROM dim", "dim"))
def _(spark, folder):
    return timeline.car_dim(Timing(spark, folder).lap)


_PLACED = (
    "SELECT event, klass, car, row_number() OVER (PARTITION BY event, klass"
    " ORDER BY length(car), car) AS place FROM dim"
)


@query("class_members", sql(_PLACED, "dim"))
def _(spark, folder):
    timing = Timing(spark, folder)
    return timeline.class_members(timeline.car_dim(timing.lap), timing.hot_class).drop("slot")


@query(
    "palette_slot",
    sql(f"SELECT event, klass, car, (place - 1) % 16 AS slot FROM ({_PLACED})", "dim"),
)
def _(spark, folder):
    timing = Timing(spark, folder)
    return timeline.class_members(timeline.car_dim(timing.lap), timing.hot_class).drop("place")


@query("class_max_lap", sql("SELECT event, klass, max_lap FROM max_lap", "max_lap"))
def _(spark, folder):
    return timeline.class_max_lap(Timing(spark, folder).lap)


@query("class_sector_avg", sql("SELECT event, klass, sector, avg_s FROM class_avg", "class_avg"))
def _(spark, folder):
    return timeline.class_sector_avg(Timing(spark, folder).lap)


@query(
    "class_sector_avg_green",
    sql(
        """
SELECT p.event, p.klass, p.sector,
  coalesce(floor((a.total * 20 + a.n * 1000000) / (a.n * 2000000)) / 10, 0.0) AS avg_s
FROM (SELECT DISTINCT event, klass, CAST(sector AS BIGINT) AS sector FROM dim, range(1, 6) g(sector)) p
LEFT JOIN (SELECT d.event, d.klass, r.sector, CAST(sum(r.s) AS BIGINT) AS total, count(*) AS n
  FROM raw_sector r JOIN dim d USING (event, car) WHERE r.pit_status = 'N' AND r.s IS NOT NULL
  GROUP BY d.event, d.klass, r.sector) a
ON a.event = p.event AND a.klass = p.klass AND a.sector = p.sector""",
        "raw_sector", "dim",
    ),
)
def _(spark, folder):
    return timeline.class_sector_avg_green(timeline.pit_status(Timing(spark, folder).lap))


@query(
    "class_position",
    sql("SELECT event, klass, car, k, lap, sector, t, position FROM chart", "chart"),
)
def _(spark, folder):
    return positions(Timing(spark, folder))


@query(
    "progress_chart",
    sql(
        "SELECT event, klass, car, k, lap, sector, round(((lap - 1) * 5 + sector) / 5.0, 4)::DOUBLE"
        " AS progress, position, t FROM chart",
        "chart",
    ),
)
def _(spark, folder):
    return timeline.progress_chart(positions(Timing(spark, folder)))


@query(
    "lap_positions",
    sql("SELECT event, klass, car, lap, position FROM chart WHERE sector = 5", "chart"),
)
def _(spark, folder):
    return timeline.lap_positions(positions(Timing(spark, folder)))


_MEANS = ", ".join(
    f"round(avg(avg_s) FILTER (sector = {i}), 4) AS avg_s{i}" for i in range(1, 6)
)


@query(
    "all_classes",
    sql(
        f"""
SELECT * FROM (SELECT event, count(*) AS cars FROM dim GROUP BY event)
JOIN (SELECT event, max(max_lap) AS max_lap FROM max_lap GROUP BY event) USING (event)
JOIN (SELECT event, {_MEANS} FROM class_avg GROUP BY event) USING (event)""",
        "dim", "max_lap", "class_avg",
    ),
)
def _(spark, folder):
    # Means are over published values: a repaired sector is not one.
    laps = Timing(spark, folder).lap
    return timeline.all_classes(
        timeline.car_dim(laps), timeline.class_max_lap(laps), timeline.class_sector_avg(laps)
    )


_EACH = ", ".join(f"max(avg_s) FILTER (sector = {i}) AS avg_s{i}" for i in range(1, 6))


@query(
    "dataset_report",
    sql(
        f"""
SELECT *, stops - full_windows AS missing_exit
FROM (SELECT event, klass, count(*) AS cars FROM dim GROUP BY event, klass)
JOIN max_lap USING (event, klass)
JOIN (SELECT event, klass, {_EACH} FROM class_avg GROUP BY event, klass) USING (event, klass)
JOIN (SELECT event, min(t0) AS t_min, max(t1) AS t_max FROM leg GROUP BY event) USING (event)
JOIN (SELECT event, count(*) FILTER (inpit) AS stops,
  count(*) FILTER (pit_in IS NOT NULL AND pit_dur IS NOT NULL) AS full_windows
  FROM lap GROUP BY event) USING (event)""",
        "dim", "max_lap", "class_avg", "leg", "lap",
    ),
)
def _(spark, folder):
    timing = Timing(spark, folder)
    laps = timing.lap.withColumn("published", F.col("s"))
    return timeline.dataset_report(ingest.repair_dropped_sector(laps, LONGEST_SECTOR), "published")


# Caps of the clean-up, in the stand-in's slow time.
SECTOR_CAP, LAP_CAP = 60 * HOUR, 200 * HOUR


def cleaned_parts(prefix: str, source: str, sector_cap: int, lap_cap: int) -> str:
    """Register the feed's clean-up of `source` as SQL in three steps; returns its select list."""
    part(
        f"{prefix}_shown",
        "SELECT event, car, klass, lap, "
        + ", ".join(f"CASE WHEN s{i} <= {sector_cap} THEN s{i} END AS s{i}" for i in range(1, 6))
        + f", tend, CASE WHEN rt <= {lap_cap} THEN rt END AS rt, inpit, driver, vehicle, v1 FROM {source}",
        source,
    )
    part(
        f"{prefix}_own",
        f"""
SELECT a.event, a.car, a.klass, a.lap, a.s1, a.s2, a.s3, a.s4,
  coalesce(a.s5, b.rt - (a.s1 + a.s2 + a.s3 + a.s4)) AS s5, a.tend, a.inpit, a.driver, a.vehicle, a.v1,
  CASE WHEN b.lap IS NOT NULL THEN b.rt ELSE a.rt END AS rt
FROM {prefix}_shown a LEFT JOIN {prefix}_shown b ON b.event = a.event AND b.car = a.car AND b.lap = a.lap + 1""",
        f"{prefix}_shown",
    )
    part(
        f"{prefix}_holes",
        f"""
SELECT *, (s1 IS NULL)::INT + (s2 IS NULL)::INT + (s3 IS NULL)::INT + (s4 IS NULL)::INT AS missing,
  rt - (coalesce(s1, 0) + coalesce(s2, 0) + coalesce(s3, 0) + coalesce(s4, 0) + coalesce(s5, 0)) AS hole
FROM {prefix}_own""",
        f"{prefix}_own",
    )
    fits = f"missing = 1 AND s5 IS NOT NULL AND rt <> 0 AND hole > 0 AND hole < {sector_cap}"
    filled = ", ".join(f"CASE WHEN s{i} IS NULL AND {fits} THEN hole ELSE s{i} END AS s{i}" for i in range(1, 5))
    return f"event, car, klass, lap, {filled}, s5, tend, rt, inpit"


CLEANED_LAPS = cleaned_parts("live", "lap", SECTOR_CAP, LAP_CAP)


@query("live_clean_laps", sql(f"SELECT {CLEANED_LAPS} FROM live_holes", "live_holes"))
def _(spark, folder):
    laps = live_laps.clean_live(Timing(spark, folder).lap, SECTOR_CAP, LAP_CAP)
    return laps.select(
        "event", "car", "klass", "lap", *[F.col("s")[i].alias(f"s{i + 1}") for i in range(5)], "tend", "rt", "inpit"
    )
