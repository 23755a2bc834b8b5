"""Distance, wear and usage queries."""

from pyspark.sql import functions as F

from apexline.functions.ordered import has_hot_group
from apexline.operators import telemetry
from apexline.plans.asof import Race
from apexline.plans.registry import part, query, sql
from apexline.sources.standins import Timing, day_text
from apexline.sources.tables import table

NAMES = list(telemetry.COMPONENTS)
_NAMES = "['" + "', '".join(NAMES) + "']"

part(
    "sample",
    """
SELECT event, car, t, event_id, CASE WHEN k % 13 <> 0 THEN (lap - 1) * 5 + sector + (k % 10) / CAST(10 AS DOUBLE)
  - CASE WHEN k % 17 = 0 THEN 7 ELSE 0 END END AS p FROM crossing""",
    "crossing",
)
part(
    "reached",
    """
SELECT *, CAST(floor(p / 5) AS BIGINT) * 24400000 + [0, 3300, 6600, 12600, 22000][s + 1] * 1000
  + CAST(round((p - floor(p / 5) * 5 - s) * [3300, 3300, 6000, 9400, 2400][s + 1] * 1000) AS BIGINT) AS mm
FROM (SELECT *, greatest(0, least(4, CAST(floor(p - floor(p / 5) * 5) AS BIGINT))) AS s FROM sample)""",
    "sample",
)


@query(
    "driven_km",
    sql(
        """
SELECT event, car, coalesce(CAST(sum(CASE WHEN p > p0 THEN greatest(mm - mm0, 0) END) AS BIGINT), 0)
  / CAST(1000000 AS DOUBLE) AS km
FROM (SELECT *, lag(p) OVER w AS p0, lag(mm) OVER w AS mm0 FROM reached
  WINDOW w AS (PARTITION BY event, car ORDER BY t, event_id)) GROUP BY event, car""",
        "reached",
    ),
)
def _(spark, folder):
    timing = Timing(spark, folder)
    k = F.col("k")
    progress = (
        (F.col("lap") - 1) * 5 + F.col("sector") + (k % 10) / 10
        - F.when(k % 17 == 0, 7).otherwise(0)
    )
    samples = timing.crossing.select(
        "event", "car", F.col("t").alias("at"), F.col("event_id").alias("id"),
        F.when(k % 13 != 0, progress).alias("progress"),
    )
    return telemetry.driven_km(samples, hot_car=timing.hot_car)


part(
    "part_day",
    f"""
SELECT l_suppkey AS car, {_NAMES}[l_linenumber] AS component, l_linenumber AS n,
  epoch_us(l_shipdate) // 86400000000 AS id, CAST(sum(l_quantity) AS BIGINT) AS actual
FROM lineitem GROUP BY ALL""",
)


def part_days(spark, folder):
    """Quantity shipped per supplier, line number and day: a part's kilometres."""
    lines = table(spark, folder, "lineitem")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("l_linenumber"))
    return lines.groupBy(
        F.col("l_suppkey").alias("car"), name.alias("component"),
        F.unix_date(F.to_date("l_shipdate")).cast("bigint").alias("id"),
    ).agg(F.sum("l_quantity").cast("bigint").alias("actual"))


def _state(spark, folder):
    days = part_days(spark, folder).groupBy("car", "component").agg(F.sum("actual").alias("actual"))
    return days.select(
        "car", "component",
        F.when(F.col("car") % 4 == 0, 0).when(F.col("car") % 4 == 1, F.length("component") * 200)
        .cast("bigint").alias("interval"),
        "actual",
    )


_STANDARD = ", ".join(f"('{c}', {i}, {n})" for n, (c, i) in enumerate(telemetry.COMPONENTS.items()))


@query(
    "component_wear",
    sql(
        f"""
, st AS (SELECT car, component, CASE car % 4 WHEN 0 THEN 0 WHEN 1 THEN length(component) * 200 END AS interval,
  CAST(sum(actual) AS BIGINT) AS actual FROM part_day GROUP BY car, component),
w AS (SELECT c.car, d.component, d.n, coalesce(st.interval, d.standard) AS interval,
  coalesce(st.actual, 0) AS actual FROM (SELECT DISTINCT car FROM st) c
  CROSS JOIN (VALUES {_STANDARD}) d(component, standard, n)
  LEFT JOIN st ON st.car = c.car AND st.component = d.component)
SELECT car, component, CAST(interval AS BIGINT) AS interval, actual,
  CASE WHEN interval > 0 THEN interval - actual END AS "left",
  CASE WHEN interval > 0 THEN actual / CAST(interval AS DOUBLE) END AS share,
  CASE WHEN interval = 0 THEN 'on condition' WHEN actual / CAST(interval AS DOUBLE) >= 1 THEN 'due'
    WHEN actual / CAST(interval AS DOUBLE) >= 0.85 THEN 'warn' ELSE 'ok' END AS state,
  row_number() OVER (PARTITION BY car ORDER BY interval = 0, interval, n) AS place FROM w""",
        "part_day",
    ),
)
def _(spark, folder):
    return telemetry.component_wear(_state(spark, folder))


def _swaps(spark, folder):
    odometer = F.when(F.col("id") % 4 != 0, F.col("id") * 10 + F.col("car") % 7)
    return part_days(spark, folder).withColumn("odometer", odometer)


part(
    "swap",
    "SELECT *, CASE WHEN id % 4 <> 0 THEN id * 10 + car % 7 END AS odometer FROM part_day",
    "part_day",
)
part(
    "life",
    """
SELECT car, component, id, row_number() OVER w AS part_no, coalesce(lag(odo_out) OVER w, 0) AS odo_in, odo_out,
  odo_out - coalesce(lag(odo_out) OVER w, 0) AS km
FROM (SELECT *, CAST(coalesce(odometer, coalesce(last_reading, 0) + since) AS BIGINT) AS odo_out FROM (
  SELECT *, sum(CASE WHEN odometer IS NULL THEN actual ELSE 0 END)
    OVER (PARTITION BY car, component, run ORDER BY id) AS since,
    max(odometer) OVER (PARTITION BY car, component, run) AS last_reading
  FROM (SELECT *, count(odometer) OVER (PARTITION BY car, component ORDER BY id) AS run FROM swap)))
WINDOW w AS (PARTITION BY car, component ORDER BY id)""",
    "swap",
)


def _life(spark, folder):
    hot = has_hot_group(
        table(spark, folder, "lineitem").select("l_suppkey", "l_linenumber"),
        ["l_suppkey", "l_linenumber"],
    )
    return telemetry.part_life(_swaps(spark, folder), hot)


@query("part_life", sql("SELECT * FROM life", "life"))
def _(spark, folder):
    return _life(spark, folder)


_CELLS = ", ".join(f"max(cell) FILTER (component = '{c}') AS {c}" for c in NAMES)


@query(
    "part_archive",
    sql(
        f"""
, fit AS (SELECT car, component, arg_max(odo_out, part_no) AS odo, max(part_no) AS n, car % 90 AS actual
  FROM life GROUP BY car, component),
cells AS (SELECT car, component, part_no, odo_in || ' - ' || odo_out || ' : ' || km AS cell FROM life
  UNION ALL SELECT car, component, n + 1, odo || ' - IN USE ~ ' || (odo + actual) || ' : ~ ' || actual FROM fit)
SELECT car, part_no, {_CELLS} FROM cells GROUP BY car, part_no""",
        "life",
    ),
)
def _(spark, folder):
    life = _life(spark, folder)
    fitted = life.groupBy("car", "component").agg(F.max_by("odo_out", "part_no").alias("odo"))
    return telemetry.part_archive(life, fitted.withColumn("actual", F.col("car") % 90))


part(
    "use",
    """
SELECT user_id AS session, event_type AS panel, epoch_us(ts) // 86400000000 AS day, epoch_us(ts) AS at_us,
  event_id, CAST(round(value * 100) AS BIGINT) AS seconds FROM events""",
)


@query(
    "usage_ranking",
    sql(
        """
SELECT panel, seconds, rank() OVER (ORDER BY seconds DESC) AS rank,
  greatest(2, (seconds * 200 + max(seconds) OVER ()) // (2 * max(seconds) OVER ())) AS share, sessions
FROM (SELECT panel, CAST(sum(seconds) AS BIGINT) AS seconds, count(DISTINCT session) AS sessions
  FROM (SELECT session, panel, day, arg_max(seconds, at_us) AS seconds FROM "use" GROUP BY ALL)
  GROUP BY panel)""",
        "use",
    ),
)
def _(spark, folder):
    events = Timing(spark, folder).events
    usage = events.select(
        F.col("car").alias("session"), F.col("event_type").alias("panel"),
        day_text(F.col("t")).alias("date"), F.col("t").alias("at"), F.col("cents").alias("seconds"),
    )
    return telemetry.usage_ranking(usage)


AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Version/17.1 Safari/605.1",
    "Mozilla/5.0 (Linux; Android 14) Chrome/119.0 Mobile",
    "Mozilla/5.0 (X11; Linux x86_64) Firefox/118.0",
    "a plain client without any of the known names in it",
)


@query(
    "visitor_log",
    sql(
        f"""
, v AS (SELECT event_id AS id, epoch_us(ts) AS ts, CASE WHEN user_id % 9 <> 0 THEN '10.0.' || (user_id % 5)
    || '.' || user_id ELSE '' END AS ip,
  CASE WHEN event_id % 3 <> 0 THEN {list(AGENTS)}[event_id % 5 + 1] END AS ua FROM events
  ORDER BY ts DESC, id DESC LIMIT 2000)
SELECT ip, visits, first_seen, last_seen, ua, CASE WHEN ua LIKE '%Edg%' THEN 'Edge · Windows'
  WHEN ua LIKE '%Mac OS X%' THEN 'Safari · macOS' WHEN ua LIKE '%Android%' THEN 'Chrome · Android'
  WHEN ua LIKE '%Firefox%' THEN 'Firefox · Linux' ELSE ua[1:40] END AS browser
FROM (SELECT coalesce(nullif(ip, ''), '(unknown)') AS ip, count(*) AS visits, min(ts) AS first_seen,
  max(ts) AS last_seen, arg_min(ua, ts) FILTER (ua IS NOT NULL) AS ua FROM v GROUP BY 1)""",
    )
    .replace("\n, v AS", "WITH v AS", 1),
)
def _(spark, folder):
    user, at = F.col("user_id"), F.col("event_id")
    visits = table(spark, folder, "events").select(
        at.alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.when(user % 9 != 0, F.concat(F.lit("10.0."), user % 5, F.lit("."), user)).otherwise("").alias(
            "ip"
        ),
        F.when(
            at % 3 != 0,
            F.element_at(F.array(*[F.lit(a) for a in AGENTS]), (at % 5 + 1).cast("int")),
        ).alias("ua"),
    )
    return telemetry.visitor_log(visits)


@query(
    "unread_count",
    """
WITH m AS (SELECT conv_id % 5 AS channel, conv_id * 100 + turn AS id, role AS sender FROM conversations),
c AS (SELECT channel AS name, CASE WHEN channel % 2 = 0 THEN 'user' ELSE 'assistant' END AS owner,
  max(id) // 2 + channel AS cursor FROM m GROUP BY channel)
SELECT 'ch' || c.name AS name, count(m.id) AS unread FROM c LEFT JOIN m
ON m.channel IN (c.name, (c.name + 1) % 5) AND m.id > c.cursor AND m.sender <> c.owner GROUP BY c.name""",
)
def _(spark, folder):
    messages = table(spark, folder, "conversations").select(
        (F.col("conv_id") % 5).alias("channel"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("sender"),
    )
    columns = messages.groupBy("channel").agg(
        (F.call_function("div", F.max("id"), F.lit(2)) + F.col("channel")).alias("cursor")
    ).select(
        F.concat(F.lit("ch"), "channel").alias("name"),
        F.array(F.col("channel"), (F.col("channel") + 1) % 5).alias("channels"),
        F.when(F.col("channel") % 2 == 0, "user").otherwise("assistant").alias("owner"), "cursor",
    )
    return telemetry.unread_count(messages, columns)


@query(
    "fastest_flag",
    sql(
        """
SELECT f.event, d.klass, f.car, f.lap, f.rt,
  f.rt = min(f.rt) OVER (PARTITION BY f.event, f.car) AS fastest_of_car,
  f.rt = min(f.rt) OVER (PARTITION BY f.event, d.klass) AS fastest_of_class
FROM fixed f JOIN dim d ON d.event = f.event AND d.car = f.car WHERE f.rt > 0""",
        "fixed", "dim",
    ),
)
def _(spark, folder):
    race = Race(spark, folder)
    return telemetry.fastest_flag(race.laps, race.dim)
