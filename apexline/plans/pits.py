"""Pit-stop and stint queries."""

from functools import cached_property

from pyspark.sql import functions as F

from apexline.functions.ordered import has_hot_group
from apexline.functions.session import cut
from apexline.operators import pits, timeline
from apexline.plans.asof import Race
from apexline.plans.registry import part, query, sql
from apexline.sources.standins import DAY, Timing
from apexline.sources.tables import table

# The stand-in's laps take days: one of its seconds is 400 of a race's.
TICKS = 400_000_000


class Box(Race):
    """Stops of the stand-in race with everything known about them."""

    def __init__(self, spark, folder):
        super().__init__(spark, folder)
        self.laps = cut(timeline.pit_status(self.laps))

    @cached_property
    def flagged(self):
        return self.laps.filter("inpit").select("event", "car", "lap", "pit_in", "pit_dur")

    @cached_property
    def green(self):
        return pits.green_medians(self.laps, self.timing.hot_car)

    @cached_property
    def stints(self):
        return pits.stints(self.laps, self.flagged, self.timing.hot_car)

    @cached_property
    def entries(self):
        return pits.pit_entry_time(self.flagged, self.legs, TICKS)

    @cached_property
    def stopped(self):
        return pits.stopped_estimate(self.flagged, self.legs, self.green)

    @cached_property
    def last_hour(self):
        """Minimum by minutes left; the rule is a stand-in for the regulation table."""
        return self.timing.spark.range(1, 60).select(
            F.col("id").alias("minutes"),
            F.expr("28 + (id - 1) * 130 div 58").alias("seconds"),
        )

    @cached_property
    def minima(self):
        ends = self.laps.groupBy("event").agg(F.max("tend").alias("race_end"))
        stops = (
            self.stints.filter("stopped")
            .select("event", "car", F.col("last_lap").alias("lap"), F.col("stint").alias("stop"), "laps")
            .join(self.entries.select("event", "car", "lap", "anchor"), ["event", "car", "lap"])
            .join(ends, "event")
        )
        return pits.minimum_stop(stops, self.last_hour, TICKS)

    @cached_property
    def margins(self):
        both = self.minima.join(self.stopped.drop("estimate"), ["event", "car", "lap"]).join(
            self.dim.select("event", "car", "klass"), ["event", "car"]
        )
        return pits.stop_margin(both, TICKS)

    @cached_property
    def totals(self):
        return pits.margin_totals(self.margins, TICKS)

    @cached_property
    def hot_field(self):
        return has_hot_group(self.timing.events.select("event", "car").distinct(), ["event"])


part("first_leg", "SELECT event, car, lap, t0, t1 - t0 AS dur FROM leg WHERE sector = 1", "leg")
part(
    "slow_first",
    f"""
SELECT event, car, lap - 1 AS lap FROM first_leg JOIN (
  SELECT event, car, CAST(round(2 * quantile_cont(dur, 0.5)) AS BIGINT) AS m2 FROM first_leg GROUP BY ALL)
USING (event, car) WHERE lap > 1 AND dur * 4 > m2 * 3 AND dur * 2 - m2 > {80 * TICKS}""",
    "first_leg",
)
part("flagged", "SELECT event, car, lap, pit_in, pit_dur FROM lap WHERE inpit", "lap")
part(
    "inferred",
    """
SELECT coalesce(s.event, f.event) AS event, coalesce(s.car, f.car) AS car, coalesce(s.lap, f.lap) AS lap,
  CASE WHEN f.car IS NULL THEN 'inferred' WHEN s.car IS NULL THEN 'flag' ELSE 'both' END AS source
FROM slow_first s FULL JOIN flagged f ON f.event = s.event AND f.car = s.car AND f.lap = s.lap""",
    "slow_first", "flagged",
)
part(
    "stint",
    """
SELECT event, car, stint, min(lap) AS first_lap, max(lap) AS last_lap,
  max(lap) - coalesce(max(since), 0) AS laps, arg_max(driver, lap) AS driver, max(pit) = 1 AS stopped
FROM (SELECT event, car, lap, driver, CASE WHEN inpit THEN 1 ELSE 0 END AS pit,
  CAST(1 + coalesce(sum(CASE WHEN inpit THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS stint,
  max(CASE WHEN inpit THEN lap END) OVER w AS since FROM lap
  WINDOW w AS (PARTITION BY event, car ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
GROUP BY event, car, stint""",
    "lap",
)
part(
    "stop_leg",
    """
SELECT f.event, f.car, f.lap, f.pit_in, f.pit_dur, n.t0 AS line, n.dur AS out_s1, n.t0 - s.t1 AS hole
FROM flagged f LEFT JOIN first_leg n ON n.event = f.event AND n.car = f.car AND n.lap = f.lap + 1
LEFT JOIN leg s ON s.event = f.event AND s.car = f.car AND s.lap = f.lap AND s.sector = 4""",
    "flagged", "first_leg", "leg",
)
part(
    "entry",
    f"""
SELECT event, car, lap, coalesce(pit_in, line - {842 * TICKS // 100}) AS anchor, pit_in IS NOT NULL AS is_real
FROM stop_leg""",
    "stop_leg",
)
part(
    "green",
    """
SELECT event, car, CAST(round(2 * quantile_cont(s1, 0.5)) AS BIGINT) AS g1,
  CAST(round(2 * quantile_cont(s5, 0.5)) AS BIGINT) AS g5 FROM fixed WHERE pit_status = 'N' GROUP BY event, car""",
    "fixed",
)
part(
    "standing",
    """
SELECT event, car, lap, coalesce(CAST(pit_dur AS DOUBLE), ((hole + out_s1) * 2 - g5 - g1) / 2.0) AS stopped,
  pit_dur IS NOT NULL AS is_real, ((hole + out_s1) * 2 - g5 - g1) / CAST(2 AS DOUBLE) AS estimate
FROM stop_leg LEFT JOIN green USING (event, car)""",
    "stop_leg", "green",
)
part(
    "minimum",
    f"""
SELECT event, car, lap, stop, laps, anchor, race_end,
  CAST(CASE WHEN minutes <= 59 THEN 28 + (minutes - 1) * 130 // 58 WHEN stop = 1 THEN a ELSE a - 8 END AS BIGINT)
    AS minimum,
  CASE WHEN minutes <= 59 THEN 'C' WHEN stop = 1 THEN 'A' ELSE 'B' END AS "table"
FROM (SELECT s.event, s.car, s.last_lap AS lap, s.stint AS stop, s.laps, e.anchor, r.race_end,
  [64, 82, 101, 119, 138, 156, 175, 193, 212, 230][least(s.laps, 10)] AS a,
  greatest(1, CAST(ceil((r.race_end - e.anchor) / {60 * TICKS}.0) AS BIGINT)) AS minutes
  FROM stint s JOIN entry e ON e.event = s.event AND e.car = s.car AND e.lap = s.last_lap
  JOIN (SELECT event, max(tend) AS race_end FROM lap GROUP BY event) r ON r.event = s.event WHERE s.stopped)""",
    "stint", "entry", "lap",
)
part(
    "margin",
    f"""
SELECT m.*, d.klass, s.stopped, s.is_real, coalesce(s.stopped > {600 * TICKS}, false) AS repair,
  CASE WHEN NOT coalesce(s.stopped > {600 * TICKS}, false) THEN s.stopped - m.minimum * {TICKS} END AS margin
FROM minimum m JOIN standing s USING (event, car, lap) JOIN dim d USING (event, car)""",
    "minimum", "standing", "dim",
)
part(
    "margin_total",
    f"""
SELECT event, klass, car, count(margin) AS stops, sum(stopped) FILTER (margin IS NOT NULL) AS stopped,
  CAST(sum(minimum * {TICKS}) FILTER (margin IS NOT NULL) AS BIGINT) AS floor, sum(margin) AS given_away,
  count(*) FILTER (repair) AS repairs, count(*) FILTER (NOT is_real AND NOT repair) AS estimated
FROM margin GROUP BY event, klass, car""",
    "margin",
)


@query("pit_laps_inferred", sql("SELECT * FROM inferred", "inferred"))
def _(spark, folder):
    box = Box(spark, folder)
    return pits.pit_laps_inferred(box.legs, box.flagged, TICKS, box.timing.hot_car)


# A lap that neither has a time nor is followed by another one is still being driven.
_SILENT = """
SELECT event, car, lap FROM lap a WHERE s5 IS NULL AND (rt IS NOT NULL
  OR lap < (SELECT max(lap) FROM lap b WHERE b.event = a.event AND b.car = a.car))"""


@query("pit_laps_no_last_sector", sql(_SILENT, "lap"))
def _(spark, folder):
    return pits.pit_laps_no_last_sector(Timing(spark, folder).lap)


_QUALITY = """
SELECT '{0}' AS detector, coalesce(d.event, f.event) AS event,
  count(*) FILTER (d.car IS NOT NULL AND f.car IS NOT NULL) AS tp,
  count(*) FILTER (f.car IS NULL) AS fp, count(*) FILTER (d.car IS NULL) AS fn
FROM ({1}) d FULL JOIN flagged f ON f.event = d.event AND f.car = d.car AND f.lap = d.lap GROUP BY ALL"""


@query(
    "detector_quality",
    sql(
        _QUALITY.format("first_sector", "SELECT event, car, lap FROM slow_first")
        + " UNION ALL "
        + _QUALITY.format("no_last_sector", _SILENT),
        "slow_first", "flagged", "lap",
    ),
)
def _(spark, folder):
    box = Box(spark, folder)
    slow = pits.pit_laps_inferred(box.legs, box.flagged, TICKS, box.timing.hot_car).filter(
        "source <> 'flag'"
    )
    by_first = pits.detector_quality(slow, box.flagged)
    by_last = pits.detector_quality(pits.pit_laps_no_last_sector(box.timing.lap), box.flagged)
    return by_first.withColumn("detector", F.lit("first_sector")).unionByName(
        by_last.withColumn("detector", F.lit("no_last_sector"))
    )


@query("stints", sql("SELECT * FROM stint", "stint"))
def _(spark, folder):
    return Box(spark, folder).stints


@query("pit_entry_time", sql("SELECT * FROM entry", "entry"))
def _(spark, folder):
    return Box(spark, folder).entries


@query(
    "anchor_guard",
    sql(
        f"""
SELECT event, car, lap, hole, coalesce(hole * 2 - g5 > {24 * TICKS}, false) AS guarded
FROM stop_leg LEFT JOIN green USING (event, car)""",
        "stop_leg", "green",
    ),
)
def _(spark, folder):
    box = Box(spark, folder)
    return pits.anchor_guard(box.flagged, box.legs, box.green, TICKS)


@query("stopped_estimate", sql("SELECT * FROM standing", "standing"))
def _(spark, folder):
    return Box(spark, folder).stopped


part(
    "meeting",
    """
SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS event_date,
  epoch_us(o_orderdate) // 86400000000 AS day FROM orders""",
)


def meetings(spark, folder):
    """One event per order date."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("day")
    dates = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").cast("string").alias("event_date"), day
    )
    return dates.distinct()


@query(
    "race_end",
    sql(
        f"""
SELECT 'M' || day AS event, event_date, CASE WHEN day % 7 = 0 THEN day * {DAY} + 1
  WHEN day % 5 = 0 THEN day * {DAY} + 2 WHEN day % 3 = 0 THEN day * {DAY} + 3
  ELSE (day * {DAY} + day * 1000003) // 900000000 * 900000000 + 14400000000 END AS race_end,
  CASE WHEN day % 7 = 0 THEN 'override' WHEN day % 5 = 0 THEN 'window' WHEN day % 3 = 0 THEN 'schedule'
  ELSE 'derived' END AS source FROM meeting""",
        "meeting",
    ),
)
def _(spark, folder):
    found = meetings(spark, folder).withColumn("event", F.concat(F.lit("M"), "day"))

    def given(every, plus):
        ts = (F.col("day") * DAY + plus).alias("ts")
        return found.filter(F.col("day") % every == 0).select("event", "event_date", ts)

    events = found.select(
        "event", "event_date", (F.col("day") * DAY + F.col("day") * 1_000_003).alias("start")
    )
    return pits.race_end(events, given(7, 1), given(5, 2), given(3, 3))


@query("minimum_stop", sql("SELECT * FROM minimum", "minimum"))
def _(spark, folder):
    return Box(spark, folder).minima


@query(
    "stop_margin",
    sql(
        'SELECT event, klass, car, lap, stop, stopped, minimum, "table", is_real, margin FROM margin'
        " WHERE NOT repair",
        "margin",
    ),
)
def _(spark, folder):
    return Box(spark, folder).margins.filter("not repair").select(
        "event", "klass", "car", "lap", "stop", "stopped", "minimum", "table", "is_real", "margin"
    )


@query(
    "stop_margin_totals",
    sql("SELECT event, klass, car, stops, stopped, floor, given_away FROM margin_total",
        "margin_total"),
)
def _(spark, folder):
    return Box(spark, folder).totals.select(
        "event", "klass", "car", "stops", "stopped", "floor", "given_away"
    )


@query(
    "repair_split",
    sql("SELECT event, klass, car, stops, repairs, estimated FROM margin_total", "margin_total"),
)
def _(spark, folder):
    return Box(spark, folder).totals.select(
        "event", "klass", "car", "stops", "repairs", "estimated"
    )


part(
    "measured",
    """
SELECT event, klass, car, given_away, CASE WHEN given_away < 0 THEN 'under' ELSE 'over' END AS side
FROM margin_total WHERE estimated = 0 AND stops > 0""",
    "margin_total",
)


@query(
    "margin_extremes",
    sql(
        """
SELECT *, row_number() OVER (PARTITION BY event, side ORDER BY given_away, length(car), car) AS place
FROM measured QUALIFY place <= 5""",
        "measured",
    ),
)
def _(spark, folder):
    return pits.margin_extremes(Box(spark, folder).totals)


@query(
    "margin_callouts",
    sql(
        """
SELECT s.event, s.klass, m.side, CASE WHEN s.own THEN 'class' ELSE 'field' END AS scope, m.car, m.given_away
FROM (SELECT event, klass, count(*) FILTER (stops > 0) >= 2 AS own FROM margin_total GROUP BY ALL) s
JOIN measured m ON m.event = s.event AND (NOT s.own OR m.klass = s.klass)
QUALIFY row_number() OVER (PARTITION BY s.event, s.klass, m.side
  ORDER BY m.given_away, length(m.car), m.car) = 1""",
        "margin_total", "measured",
    ),
)
def _(spark, folder):
    return pits.margin_callouts(Box(spark, folder).totals)


@query(
    "release_time",
    sql(
        f"""
SELECT event, car, lap, minimum, anchor + (minimum + 2) * {TICKS} AS release,
  anchor + (minimum + 2) * {TICKS} - (anchor + {30 * TICKS}) AS remaining FROM minimum""",
        "minimum",
    ),
)
def _(spark, folder):
    # Asked thirty seconds into each stop.
    return pits.release_time(Box(spark, folder).minima, F.col("anchor") + 30 * TICKS, TICKS)


@query(
    "position_if_clean",
    sql(
        """
, final AS (SELECT event, car, max(lap) AS done, arg_max(CAST(tend AS DOUBLE), lap) AS t, klass
  FROM fixed JOIN dim USING (event, car, klass) GROUP BY event, car, klass),
q AS (SELECT f.*, greatest(m.given_away, 0.0) AS saved FROM final f JOIN margin_total m USING (event, car)
  WHERE m.estimated = 0 AND m.stops > 0)
SELECT q.event, q.klass, q.car,
  1 + count(*) FILTER (r.klass = q.klass AND (r.done > q.done OR (r.done = q.done AND r.t < q.t)))
    AS class_actual,
  1 + count(*) FILTER (r.klass = q.klass AND (r.done > q.done OR (r.done = q.done AND r.t < q.t - q.saved)))
    AS class_possible,
  1 + count(*) FILTER (r.done > q.done OR (r.done = q.done AND r.t < q.t)) AS overall_actual,
  1 + count(*) FILTER (r.done > q.done OR (r.done = q.done AND r.t < q.t - q.saved)) AS overall_possible
FROM q JOIN final r ON r.event = q.event GROUP BY q.event, q.klass, q.car""",
        "fixed", "dim", "margin_total",
    ),
)
def _(spark, folder):
    box = Box(spark, folder)
    return pits.position_if_clean(box.laps, box.dim, box.totals, box.hot_field)


part(
    "miss",
    f"""
SELECT 'stopped' AS kind, abs(s.estimate - f.pit_dur) AS error
FROM standing s JOIN flagged f USING (event, car, lap) WHERE f.pit_dur IS NOT NULL AND s.estimate IS NOT NULL
UNION ALL SELECT 'anchor', CAST(abs(line - {842 * TICKS // 100} - pit_in) AS DOUBLE) FROM stop_leg
WHERE pit_in IS NOT NULL AND line IS NOT NULL""",
    "standing", "flagged", "stop_leg",
)


@query(
    "error_quantiles",
    sql(
        """
SELECT kind, max(n) AS n, """
        + ", ".join(
            f"max(error) FILTER (i = (n * {p} + 99) // 100) AS {name}"
            for p, name in ((50, "median"), (90, "p90"), (95, "p95"), (100, '"max"'))
        )
        + """
FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY error) AS i,
  count(*) OVER (PARTITION BY kind) AS n FROM miss) GROUP BY kind""",
        "miss",
    ),
)
def _(spark, folder):
    box = Box(spark, folder)
    keys = ["event", "car", "lap"]
    stopped = box.stopped.join(box.flagged, keys).select(
        F.lit("stopped").alias("kind"), *keys,
        F.when(F.col("pit_dur").isNotNull(), F.abs(F.col("estimate") - F.col("pit_dur"))).alias(
            "error"
        ),
    )
    derived = pits.pit_entry_time(
        box.flagged.withColumn("pit_in", F.lit(None).cast("bigint")), box.legs, TICKS
    )
    anchor = derived.join(box.flagged, keys).select(
        F.lit("anchor").alias("kind"), *keys,
        F.abs(F.col("anchor") - F.col("pit_in")).cast("double").alias("error"),
    )
    return pits.error_quantiles(stopped.unionByName(anchor))
