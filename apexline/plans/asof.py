"""Point-in-time queries."""

from functools import cached_property

from pyspark.sql import functions as F

from apexline.functions.ordered import has_hot_group
from apexline.functions.session import cut
from apexline.operators import asof, timeline
from apexline.plans import ingest  # noqa: F401
from apexline.plans.registry import part, query, sql
from apexline.plans.timeline import clean
from apexline.sources import frames as feed
from apexline.sources.standins import DAY, HOUR, Frames, Timing

T = 1_705_276_800_000_000  # 2024-01-15 00:00


class Race:
    """The derived tables the point-in-time queries start from.

    `stored` writes the cleaned laps down first, for queries that read them often.
    """

    def __init__(self, spark, folder, stored=False):
        self.timing, self.stored = Timing(spark, folder), stored

    @cached_property
    def laps(self):
        laps = timeline.classed(clean(self.timing), self.timing.hot_car)
        return cut(laps) if self.stored else laps

    @cached_property
    def legs(self):
        return timeline.legs(self.laps, keep=("klass",))

    @cached_property
    def dim(self):
        return timeline.car_dim(self.laps)

    @cached_property
    def bounds(self):
        return timeline.boundaries(self.laps, self.timing.hot_car)

    @cached_property
    def positions(self):
        return timeline.class_position(self.bounds, self.timing.hot_class)

    @cached_property
    def averages(self):
        return timeline.class_sector_avg(self.timing.lap)

    @cached_property
    def chosen(self):
        """The selected car of each class: its lowest start number."""
        lowest = F.min(F.struct(F.length("car"), "car")).alias("x")
        return self.dim.groupBy("event", "klass").agg(lowest).select("event", "klass", "x.car")

    @cached_property
    def hot_class_rows(self):
        return has_hot_group(self.timing.events, ["klass"])


part(
    "chosen",
    """
SELECT event, klass, car FROM dim
QUALIFY row_number() OVER (PARTITION BY event, klass ORDER BY length(car), car) = 1""",
    "dim",
)
part(
    "span",
    """
SELECT l.event, d.klass, l.car, l.lap, l.sector, l.t0, l.t1,
  least(l.t1, coalesce(lead(l.t0) OVER (PARTITION BY l.event, l.car ORDER BY l.t0, l.lap, l.sector), l.t1))
    AS until
FROM leg l JOIN dim d USING (event, car)""",
    "leg", "dim",
)
part("active", f"SELECT * FROM span WHERE t0 <= {T} AND {T} < until", "span")
part(
    "placed",
    f"""
SELECT event, klass, car, lap, sector, row_number() OVER (PARTITION BY event, klass ORDER BY
  lap * 5 + (sector - 1) + ({T} - t0) / CAST(t1 - t0 AS DOUBLE) DESC, length(car), car) AS position
FROM active""",
    "active",
)
part(
    "gap_at",
    f"""
SELECT r.event, r.klass, r.car AS ref, o.car AS other, arg_max(r.t - o.t, r.lap * 5 + r.sector) AS gap
FROM boundary r JOIN chosen c ON c.event = r.event AND c.car = r.car
JOIN boundary o ON o.event = r.event AND o.klass = r.klass AND o.lap = r.lap AND o.sector = r.sector
  AND o.car <> r.car
WHERE r.t <= {T} AND o.t <= {T} GROUP BY ALL""",
    "boundary", "chosen",
)
part(
    "pace",
    f"""
SELECT event, car, max(lap) AS laps, arg_max(rt, lap) AS last_lap, min(nullif(rt, 0)) AS fastest_lap
FROM fixed WHERE tend <= {T} GROUP BY event, car""",
    "fixed",
)


@query("active_leg", sql("SELECT event, car, lap, sector, t0, t1 FROM active", "active"))
def _(spark, folder):
    return asof.active_leg(Race(spark, folder).legs, T)


@query(
    "live_position",
    sql("SELECT event, klass, car, lap, sector, position FROM placed", "placed"),
)
def _(spark, folder):
    race = Race(spark, folder)
    return asof.live_position(race.legs, race.dim, T, race.timing.hot_class)


@query("common_gap", sql("SELECT event, klass, ref, other, gap FROM gap_at", "gap_at"))
def _(spark, folder):
    race = Race(spark, folder)
    return asof.common_gap(race.bounds, race.chosen, T)


@query(
    "gap_ahead_series",
    sql(
        """
, q AS (SELECT b.event, b.klass, b.car AS ref, b.lap AS at_lap, b.sector AS at_sector, b.t AS at
  FROM boundary b JOIN chosen c ON c.event = b.event AND c.car = b.car),
field AS (SELECT q.*, s.car, row_number() OVER (PARTITION BY q.event, q.ref, q.at, q.at_lap, q.at_sector
  ORDER BY s.lap * 5 + (s.sector - 1) + (q.at - s.t0) / CAST(s.t1 - s.t0 AS DOUBLE) DESC,
  length(s.car), s.car) AS p
  FROM q JOIN span s ON s.event = q.event AND s.klass = q.klass AND s.t0 <= q.at AND q.at < s.until),
ahead AS (SELECT m.event, m.ref, m.at_lap, m.at_sector, m.at, a.car AS ahead FROM field m JOIN field a
  ON a.event = m.event AND a.ref = m.ref AND a.at = m.at AND a.at_lap = m.at_lap
  AND a.at_sector = m.at_sector AND a.p = m.p - 1 WHERE m.car = m.ref),
gaps AS (SELECT h.event, h.ref, h.at_lap, h.at_sector, h.at, h.ahead,
  arg_max(r.t - o.t, r.lap * 5 + r.sector) AS g
  FROM ahead h JOIN boundary r ON r.event = h.event AND r.car = h.ref AND r.t <= h.at
  JOIN boundary o ON o.event = h.event AND o.car = h.ahead AND o.lap = r.lap AND o.sector = r.sector
    AND o.t <= h.at GROUP BY ALL)
SELECT q.event, q.klass, q.ref AS car, q.at_lap AS lap, q.at_sector AS sector, q.at, a.ahead,
  CASE WHEN g.g IS NOT NULL THEN greatest(g.g, 0) END AS gap
FROM q LEFT JOIN ahead a ON a.event = q.event AND a.ref = q.ref AND a.at_lap = q.at_lap
  AND a.at_sector = q.at_sector
LEFT JOIN gaps g ON g.event = q.event AND g.ref = q.ref AND g.at_lap = q.at_lap
  AND g.at_sector = q.at_sector""",
        "boundary", "chosen", "span",
    ),
)
def _(spark, folder):
    race = Race(spark, folder, stored=True)
    return asof.gap_ahead_series(
        race.legs, race.bounds, race.chosen, 6 * HOUR, race.timing.hot_car
    )


@query(
    "last_and_fastest_lap",
    sql("SELECT event, car, laps, last_lap, fastest_lap FROM pace", "pace"),
)
def _(spark, folder):
    return asof.last_and_fastest_lap(Race(spark, folder).laps, T)


@query(
    "leader_comparison",
    sql(
        f"""
, lasts AS (SELECT event, car, s1, s2, s3, s4, s5 FROM fixed WHERE tend <= {T}
  QUALIFY row_number() OVER (PARTITION BY event, car ORDER BY lap DESC) = 1),
duel AS (SELECT p.event, p.klass, p.car AS selected, p.position AS own, o.car AS rival, o.position AS theirs
  FROM placed p JOIN chosen c ON c.event = p.event AND c.car = p.car
  JOIN placed o ON o.event = p.event AND o.klass = p.klass
    AND o.position = CASE WHEN p.position = 1 THEN 2 ELSE 1 END),
sides AS (SELECT event, klass, selected, rival, 'leader' AS role, rival AS car, theirs AS position FROM duel
  UNION ALL SELECT event, klass, selected, rival, 'selected', selected, own FROM duel)
SELECT b.event, b.klass, b.selected, b.role, b.car, b.position,
  CASE WHEN b.role = 'selected' THEN g.gap END AS gap, p.fastest_lap, p.last_lap,
  l.s1, l.s2, l.s3, l.s4, l.s5,
  """
        + ", ".join(
            f"CASE WHEN b.role = 'selected' THEN l.s{i} - r.s{i} END AS d{i}" for i in range(1, 6)
        )
        + """
FROM sides b LEFT JOIN gap_at g ON g.event = b.event AND g.ref = b.selected AND g.other = b.rival
LEFT JOIN pace p ON p.event = b.event AND p.car = b.car
LEFT JOIN lasts l ON l.event = b.event AND l.car = b.car
LEFT JOIN lasts r ON r.event = b.event AND r.car = b.rival""",
        "placed", "chosen", "gap_at", "pace", "fixed",
    ),
)
def _(spark, folder):
    race = Race(spark, folder, stored=True)
    return asof.leader_comparison(
        race.laps, race.legs, race.bounds, race.dim, race.chosen, T, race.timing.hot_class
    )


@query(
    "delay_flag",
    sql(
        """
SELECT l.event, d.klass, l.car, l.lap, l.sector, l.t1 - l.t0 AS dur
FROM leg l JOIN dim d USING (event, car) JOIN class_avg a ON a.event = l.event AND a.klass = d.klass
  AND a.sector = l.sector
WHERE a.avg_s > 0 AND (l.t1 - l.t0) * 1000 > CAST(round(a.avg_s * 10) AS BIGINT) * 150000000""",
        "leg", "dim", "class_avg",
    ),
)
def _(spark, folder):
    race = Race(spark, folder)
    return asof.delay_flag(race.legs, race.dim, race.averages)


def _session(race: Race):
    """Laps after the third are the running session, earlier ones two past events."""
    day = F.when(F.col("lap") == 2, "2023-12-31").otherwise("2023-12-30").alias("event_date")
    archive = race.laps.filter("lap <= 3").select("car", day, "s", "inpit")
    laps = race.laps.filter("lap > 3")
    return laps, timeline.legs(laps), archive


def _reference(race: Race):
    laps, legs, archive = _session(race)
    averages = timeline.class_sector_avg(race.timing.lap.filter("lap > 3"))
    return asof.reference_duration(laps, legs, archive, averages, timeline.car_dim(laps), T)


_NOT_PIT = " UNION ALL ".join(
    f"SELECT event, car, lap, tend, {i} AS sector, s{i} AS v FROM fixed WHERE NOT inpit AND s{i} IS NOT NULL"
    for i in range(1, 6)
)
part("green_value", _NOT_PIT, "fixed")
part(
    "expected",
    f"""
SELECT p.event, p.klass, p.car, p.lap, p.sector, p.since, coalesce(o.v, e.v, m.v) AS expected,
  CASE WHEN o.v IS NOT NULL THEN 'own' WHEN e.v IS NOT NULL THEN 'earlier' WHEN m.v IS NOT NULL THEN 'class'
    ELSE 'none' END AS tier
FROM (SELECT l.event, d.klass, l.car, l.t1 AS since, l.lap + CASE WHEN l.sector = 5 THEN 1 ELSE 0 END AS lap,
    l.sector % 5 + 1 AS sector FROM leg l JOIN dim d USING (event, car) WHERE l.lap > 3 AND l.t1 <= {T}
  QUALIFY row_number() OVER (PARTITION BY l.event, l.car ORDER BY l.t1 DESC, l.lap DESC, l.sector DESC) = 1) p
LEFT JOIN (SELECT event, car, sector, arg_max(v, lap) AS v FROM green_value WHERE lap > 3 AND tend <= {T}
  GROUP BY ALL) o ON o.event = p.event AND o.car = p.car AND o.sector = p.sector
LEFT JOIN (SELECT car, sector, arg_max(v, day) AS v FROM (
    SELECT car, sector, CASE WHEN lap = 2 THEN '2023-12-31' ELSE '2023-12-30' END AS day,
      CAST(sum(v) AS BIGINT) // count(*) AS v FROM green_value WHERE lap <= 3 GROUP BY ALL) GROUP BY ALL) e
  ON e.car = p.car AND e.sector = p.sector
LEFT JOIN (SELECT d.event, d.klass, g.sector,
    nullif(CAST(floor((sum(g.v) * 20 + count(*) * 1000000) / (count(*) * 2000000)) AS BIGINT) * 100000, 0) AS v
  FROM (SELECT event, car, sector, s AS v FROM raw_sector WHERE lap > 3 AND NOT inpit AND s IS NOT NULL) g
  JOIN dim d USING (event, car) GROUP BY ALL) m
  ON m.event = p.event AND m.klass = p.klass AND m.sector = p.sector""",
    "leg", "dim", "green_value", "raw_sector",
)


@query("reference_duration", sql("SELECT * FROM expected", "expected"))
def _(spark, folder):
    return _reference(Race(spark, folder))


@query(
    "predicted_progress",
    sql(
        f"""
SELECT event, klass, car, lap, sector, tier,
  greatest(0.0, least(1.0, ({T} - since) / CAST(expected AS DOUBLE))) AS share,
  coalesce(({T} - since) * 100 > expected * 150, false) AS late,
  CASE WHEN {T} - since > {36 * HOUR} THEN 'parked' WHEN expected IS NULL THEN 'frozen' ELSE 'moving' END AS state
FROM expected""",
        "expected",
    ),
)
def _(spark, folder):
    return asof.predicted_progress(_reference(Race(spark, folder)), T, 50, 36 * HOUR)


@query(
    "visible_as_of",
    sql(f"SELECT car, message, created FROM message WHERE created IS NULL OR created <= {T // 1000}",
        "message"),
)
def _(spark, folder):
    messages = feed.map_messages(Frames(Timing(spark, folder)).log)
    shown = asof.visible_as_of(messages, T // 1000, "created")
    return shown.select("car", "message", "created")


@query(
    "frozen_sector_marks",
    sql(
        """
SELECT event, klass, car, lap, sector, dur, CASE WHEN best IS NULL OR dur < best THEN 'class best'
  WHEN own IS NULL OR dur < own THEN 'own best' ELSE 'none' END AS mark
FROM (SELECT event, d.klass, car, lap, sector, t1 - t0 AS dur,
  min(t1 - t0) OVER (PARTITION BY event, car, sector ORDER BY t1, lap
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own,
  min(t1 - t0) OVER (PARTITION BY event, d.klass, sector ORDER BY t1, car, lap
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
  FROM leg JOIN dim d USING (event, car))""",
        "leg", "dim",
    ),
)
def _(spark, folder):
    race = Race(spark, folder)
    return asof.frozen_sector_marks(
        race.legs, race.dim, None, race.timing.hot_car, race.hot_class_rows
    )


@query(
    "slow_zones",
    sql(
        f"""
SELECT event, sector, count(*) AS readings, count(*) FILTER (speed < 2000) AS slow,
  count(*) FILTER (speed < 2000) >= 3 AS zone
FROM leg l WHERE t1 <= {T} AND t1 > {T - 2 * DAY} AND speed IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM lap p WHERE p.inpit AND p.event = l.event AND p.car = l.car AND p.lap = l.lap)
GROUP BY event, sector""",
        "leg", "lap",
    ),
)
def _(spark, folder):
    race = Race(spark, folder)
    return asof.slow_zones(race.legs, race.laps.filter("inpit"), T, 2 * DAY, 2000, 3)


def _day_rows(spark, folder):
    frames = Frames(Timing(spark, folder)).once
    return frames, feed.flatten_leaderboard(frames)


part(
    "day_figure",
    """
SELECT event_date, count(*) AS rows, max(received) AS written, max(lap_end) AS newest,
  epoch_ms(CAST(event_date AS DATE)) AS day_start, min(received) FILTER (lap_end = top) AS advanced
FROM (SELECT *, max(lap_end) OVER (PARTITION BY event_date) AS top FROM car_row) GROUP BY event_date""",
    "car_row",
)


@query(
    "feed_state",
    sql(
        """
SELECT event_date, written + rows % 4 * 60000 - day_start - newest AS lag,
  CASE WHEN rows % 9 = 0 THEN 'OFFLINE' WHEN rows % 4 * 60000 > 150000 THEN 'SCRAPER SILENT'
    WHEN written + rows % 4 * 60000 - day_start - newest > 120000 THEN 'SOURCE STALE' ELSE 'STREAMING'
  END AS state FROM day_figure""",
        "day_figure",
    ),
)
def _(spark, folder):
    frames, rows = _day_rows(spark, folder)
    status = rows.groupBy("event_date").agg((F.count(F.lit(1)) % 9 != 0).alias("live"))
    return asof.feed_state(rows, status, F.col("written") + F.col("rows") % 4 * 60_000)


@query(
    "data_advance_age",
    sql(
        """
SELECT event_date, written + rows % 4 * 60000 - advanced AS age,
  CASE WHEN written + rows % 4 * 60000 - advanced > 180000 THEN 'stopped'
    WHEN written + rows % 4 * 60000 - advanced > 120000 THEN 'stale' ELSE 'fresh' END AS level
FROM day_figure""",
        "day_figure",
    ),
)
def _(spark, folder):
    _, rows = _day_rows(spark, folder)
    return asof.data_advance_age(rows, F.col("written") + F.col("rows") % 4 * 60_000)


@query(
    "clock_frontier",
    sql(
        """
SELECT event_date, newest, CASE WHEN rows % 60 * 1000 > 30000 THEN newest - 8000
  ELSE newest - rows % 60 * 1000 END AS clock, rows % 60 * 1000 > 30000 AS reanchored FROM day_figure""",
        "day_figure",
    ),
)
def _(spark, folder):
    _, rows = _day_rows(spark, folder)
    return asof.clock_frontier(rows, F.col("newest") - F.col("rows") % 60 * 1000)
