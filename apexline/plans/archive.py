"""Event archive queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.ordered import has_hot_group
from apexline.operators import archive
from apexline.plans.asof import Race
from apexline.plans.pits import meetings
from apexline.plans.registry import part, query, sql
from apexline.plans.results import sessions
from apexline.plans.timeline import CLEANED_LAPS, LAP_CAP, SECTOR_CAP
from apexline.operators.results import session_windows
from apexline.sources import frames as feed
from apexline.sources.standins import DAY, HOUR, Frames, Timing
from apexline.sources.tables import table

DAY_MS = DAY // 1000


def slug_inputs(spark, folder):
    day = F.col("day")
    events = meetings(spark, folder).select(
        "event_date", "day",
        F.when(day % 11 == 0, F.concat(F.lit("X"), day)).otherwise("").alias("given"),
        F.when(day % 3 == 0, F.concat(F.lit("Round nls 0"), day % 8)).alias("label"),
        F.when(day % 2 == 0, F.concat(F.lit("7. Cup, NLS"), day % 13)).otherwise("8. Cup").alias(
            "name"
        ),
    )
    rounds = events.filter("day % 5 = 0").select(
        "event_date", F.concat(F.lit("NLS"), F.col("day") % 9).alias("slug")
    )
    return events, rounds


part(
    "slug",
    """
SELECT event_date, day, CASE WHEN day % 11 = 0 THEN 'X' || day ELSE '' END AS given,
  CASE WHEN day % 3 = 0 THEN 'Round nls 0' || (day % 8) END AS label,
  CASE WHEN day % 2 = 0 THEN '7. Cup, NLS' || (day % 13) ELSE '8. Cup' END AS name,
  CASE WHEN day % 11 = 0 THEN 'X' || day WHEN day % 5 = 0 THEN 'NLS' || (day % 9)
    WHEN day % 3 = 0 AND day % 8 > 0 THEN 'NLS' || (day % 8) WHEN day % 3 = 0 THEN 'NLS0'
    WHEN day % 2 = 0 THEN 'NLS' || (day % 13) ELSE 'EVT-' || event_date END AS slug FROM meeting""",
    "meeting",
)


@query("event_slug", sql("SELECT event_date, label, name, slug FROM slug", "slug"))
def _(spark, folder):
    events, rounds = slug_inputs(spark, folder)
    return archive.event_slug(events, rounds).select("event_date", "label", "name", "slug")


_NOW = 883_612_800_000  # 1998-01-01


@query(
    "archivable_events",
    sql(
        f"""
SELECT w.event_date, max(coalesce(w.end_ts, w.start_ts)) AS last_end FROM "window" w
JOIN meeting m USING (event_date) WHERE m.day % 6 <> 0 AND EXISTS (SELECT 1 FROM orders o
  WHERE o_orderkey % 3 = 0 AND strftime(o_orderdate, '%Y-%m-%d') = w.event_date)
GROUP BY w.event_date HAVING last_end < {_NOW - 7_200_000}""",
        "window", "meeting",
    ),
)
def _(spark, folder):
    timing = table(spark, folder, "orders").filter("o_orderkey % 3 = 0").select(
        F.to_date("o_orderdate").cast("string").alias("event_date")
    )
    archived = meetings(spark, folder).filter("day % 6 = 0")
    windows = session_windows(sessions(spark, folder))
    return archive.archivable_events(windows, timing, archived, _NOW)


# The stand-in race's events.
EVENTS = ["E0", "E1"]


def _laps(timing: Timing):
    return timing.lap.select(
        "event", "car", "klass", "lap", "s", "spd", "tend", "rt", "inpit", "driver", "vehicle"
    )


def _bundle(spark, folder, only=None):
    """Every kind of an event's archive, each in its order, or the kinds named."""
    timing = Timing(spark, folder)
    laps, crossing = _laps(timing), timing.crossing
    heads = laps.groupBy("event").agg(F.max("tend").alias("archived_at")).select(
        "event", F.concat(F.lit("NLS"), F.substring("event", 2, 1)).alias("slug"), "archived_at",
        F.lit("live").alias("source"),
    )
    status = crossing.groupBy("event").agg(
        F.max("t").alias("updated"), F.count(F.lit(1)).alias("rows")
    ).withColumn("id", F.col("updated"))
    messages = crossing.filter("event_type = 'error'").select(
        "event", "car", F.col("t").alias("at"), F.col("event_id").alias("id"), "event_type"
    )
    notes = crossing.filter("event_type = 'purchase'").select(
        "event", "car", "lap", "sector", F.col("t").alias("at"), F.col("event_id").alias("id"), "k"
    )
    fuel_notes = crossing.filter("k % 11 = 0").select(
        "event", "car", "lap", F.col("event_id").alias("id"), "cents"
    )
    fuel = crossing.groupBy("event", "car").agg(F.max("counter").alias("state"))
    times = timing.lap.filter("rt is not null").select("event", "car", "driver", "lap", "rt")
    # One row an event.
    of_heads = {
        "meta": (archive.event_meta(heads, laps), ["slug"]),
        "live_status": (status, ["id"]),
    }
    of_events = {
        "timing": (laps, ["car", "lap"]),
        "messages": (messages, ["at", "id"]),
        "racenotes": (notes, ["car", "at", "id"]),
        "fuel_state": (fuel, ["car"]),
        "fuel_notes": (fuel_notes, ["car", "lap", "id"]),
        "weather": (weather_rows(timing), ["at"]),
        "laptimes": (times, ["car", "lap"]),
    }
    tyres = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("car"), F.col("p_brand").alias("state")
    )
    bands = table(spark, folder, "region").select(
        F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("texts")
    )
    of_none = {
        "tyre_state": (archive.for_each_event(tyres, EVENTS), ["car"]),
        "band_state": (archive.for_each_event(bands, EVENTS), ["id"]),
    }
    asked = [
        {kind: rows for kind, rows in kinds.items() if only is None or kind in only}
        for kinds in (of_heads, of_events, of_none)
    ]
    # Splitting a hot event writes each kind down at once, so it is done for the kinds asked for.
    hots = (lambda: False, lambda: has_hot_group(timing.events, ["event"]), lambda: None)
    parts = [archive.event_bundle(kinds, hot()) for kinds, hot in zip(asked, hots) if kinds]
    return reduce(DataFrame.unionByName, parts)


part(
    "weather",
    f"""
SELECT event, t // {HOUR} * {HOUR} AS "at", CAST(sum(cents) AS BIGINT) // count(*) AS temp
FROM crossing GROUP BY event, t // {HOUR}""",
    "crossing",
)


def weather_rows(timing: Timing):
    """One reading per event and hour: the mean of its values."""
    hour = (F.expr(f"t div {HOUR}") * HOUR).alias("at")
    mean = F.call_function("div", F.sum("cents"), F.count(F.lit(1))).alias("temp")
    return timing.crossing.groupBy("event", hour).agg(mean)


# Rows of every kind: what orders them, and the fields that name them.
_KINDS = {
    "meta": ("slug", "slug", "(SELECT event, 'NLS' || substr(event, 2, 1) AS slug FROM lap GROUP BY event)"),
    "timing": ("car, lap", "car, lap", "lap"),
    "live_status": ("id", "id", "(SELECT event, max(t) AS id FROM crossing GROUP BY event)"),
    "messages": (
        '"at", id', 'car, "at", id',
        """(SELECT event, car, t AS "at", event_id AS id FROM crossing WHERE event_type = 'error')""",
    ),
    "racenotes": (
        'car, "at", id', 'car, lap, "at", id',
        """(SELECT event, car, lap, t AS "at", event_id AS id FROM crossing WHERE event_type = 'purchase')""",
    ),
    "fuel_state": ("car", "car", "(SELECT DISTINCT event, car FROM crossing)"),
    "fuel_notes": (
        "car, lap, id", "car, lap, id",
        "(SELECT event, car, lap, event_id AS id FROM crossing WHERE k % 11 = 0)",
    ),
    "weather": ('"at"', '"at"', "weather"),
    "laptimes": ("car, lap", "car, lap", "(SELECT * FROM lap WHERE rt IS NOT NULL)"),
    "tyre_state": (
        "car", "car",
        "(SELECT e.event, CAST(p_partkey AS VARCHAR) AS car FROM part, (VALUES ('E0'), ('E1')) e(event))",
    ),
    "band_state": ("id", "id", "(SELECT e.event, r_regionkey AS id FROM region, (VALUES ('E0'), ('E1')) e(event))"),
}
_FIELDS = ["slug", "car", "lap", "at", "id"]
part(
    "bundled",
    " UNION ALL ".join(
        f"SELECT event, '{kind}' AS kind, row_number() OVER (PARTITION BY event ORDER BY {order}) AS n,"
        f" concat_ws('|', {named}) AS said FROM {rows}"
        for kind, (order, named, rows) in _KINDS.items()
    ),
    "lap", "crossing", "weather",
)


@query(
    "event_bundle",
    sql(
        """
SELECT event, kind, (n - 1) // 500 AS chunk, count(*) AS items, md5(string_agg(said, ',' ORDER BY n)) AS ordered
FROM bundled GROUP BY event, kind, (n - 1) // 500""",
        "bundled",
    ),
)
def _(spark, folder):
    def named(item):
        return F.concat_ws("|", *[F.get_json_object(item, f"$.{field}") for field in _FIELDS])

    return _bundle(spark, folder).select(
        "event", "kind", "chunk", F.size("items").alias("items"),
        F.md5(F.array_join(F.transform("items", named), ",")).alias("ordered"),
    )


@query("event_car_count", sql("SELECT event, count(DISTINCT car) AS car_count FROM lap GROUP BY event", "lap"))
def _(spark, folder):
    return archive.unbundle(_bundle(spark, folder, ["meta"]), "meta", "slug string, car_count bigint").select(
        "event", "car_count"
    )


@query("unbundle", sql(f"SELECT {CLEANED_LAPS}, v1, driver, vehicle FROM live_holes", "live_holes"))
def _(spark, folder):
    timing = Timing(spark, folder)
    hot = has_hot_group(timing.events, ["event"])
    bundle = archive.event_bundle({"timing": (_laps(timing), ["car", "lap"])}, hot)
    laps = archive.unbundle_timing(bundle, SECTOR_CAP, LAP_CAP)
    return laps.select(
        "event", "car", "klass", "lap", *[F.col("s")[i].alias(f"s{i + 1}") for i in range(5)],
        F.col("spd")[0].alias("v1"), "tend", "rt", "inpit", "driver", "vehicle",
    )


part(
    "said",
    """
SELECT o_orderkey AS id, o_orderpriority AS message, epoch_ms(o_orderdate) + (o_orderkey * 7919) % 86400 * 1000
  AS created, CASE WHEN o_orderkey % 2 = 0 AND epoch_us(o_orderdate) // 86400000000 % 3 <> 0
    THEN strftime(o_orderdate, '%Y-%m-%d') END AS event_date,
  CASE WHEN o_orderkey % 5 <> 0 THEN 'C' || (o_orderkey % 3) END AS race_class,
  strftime(o_orderdate, '%Y-%m-%d') AS day_text FROM orders""",
)


def said_rows(spark, folder):
    """Messages from orders; undated on every third day and for odd keys."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint")
    key = F.col("o_orderkey")
    text = F.to_date("o_orderdate").cast("string")
    return table(spark, folder, "orders").select(
        key.alias("id"), F.col("o_orderpriority").alias("message"),
        (day * DAY_MS + (key * 7919) % 86_400 * 1000).alias("created"),
        F.when((key % 2 == 0) & (day % 3 != 0), text).alias("event_date"),
        F.when(key % 5 != 0, F.concat(F.lit("C"), key % 3)).alias("race_class"),
        text.alias("day_text"),
    )


@query(
    "bundle_messages",
    sql(
        f"""
, ev AS (SELECT 'M' || day AS event, event_date, day * {DAY_MS} + 21600000 AS start_ts,
  CASE WHEN day % 100 <> 0 THEN day * {DAY_MS} + 64800000 END AS end_ts FROM meeting WHERE day % 2 = 0)
SELECT e.event, s.id, s.created, s.message FROM ev e JOIN said s USING (event_date)
UNION ALL SELECT e.event, s.id, s.created, s.message FROM ev e JOIN said s ON s.event_date IS NULL
  AND s.created >= e.start_ts AND (e.end_ts IS NULL OR s.created <= e.end_ts)
WHERE NOT EXISTS (SELECT 1 FROM said x WHERE x.event_date = e.event_date)""",
        "meeting", "said",
    ),
)
def _(spark, folder):
    day = F.col("day")
    events = meetings(spark, folder).filter("day % 2 = 0").select(
        F.concat(F.lit("M"), "day").alias("event"), "event_date",
        (day * DAY_MS + 21_600_000).alias("start_ts"),
        F.when(day % 100 != 0, day * DAY_MS + 64_800_000).alias("end_ts"),
    )
    return archive.bundle_messages(said_rows(spark, folder), events)


@query(
    "event_index",
    sql(
        f"""
SELECT slug, event_date, name, day % 140 AS car_count, day * {DAY_MS} + 1 AS archived_at,
  (SELECT max(day) FROM slug) * {DAY_MS} + 1 AS generated_at FROM slug""",
        "slug",
    ),
)
def _(spark, folder):
    events, rounds = slug_inputs(spark, folder)
    archived = archive.event_slug(events, rounds).select(
        "slug", "event_date", "name", (F.col("day") % 140).alias("car_count"),
        (F.col("day") * DAY_MS + 1).alias("archived_at"),
    )
    return archive.event_index(archived)


@query(
    "message_board",
    sql(
        """
SELECT id, message, created, race_class FROM said WHERE day_text = '1998-03-04'
  AND (race_class IS NULL OR race_class = 'C1') ORDER BY created DESC, id DESC LIMIT 300""",
        "said",
    ),
)
def _(spark, folder):
    said = said_rows(spark, folder).withColumn("event_date", F.col("day_text"))
    board = archive.message_board(said, "1998-03-04", "C1")
    return board.select("id", "message", "created", "race_class")


@query(
    "laps_with_weather",
    sql(
        """
SELECT l.event, l.car, l.lap, l.tend, l.rt, w."at" AS recorded_at, w.temp
FROM fixed l ASOF LEFT JOIN weather w ON w.event = l.event AND l.tend >= w."at" """,
        "fixed", "weather",
    ),
)
def _(spark, folder):
    race = Race(spark, folder)
    hot = has_hot_group(race.timing.events, ["event"])
    return archive.laps_with_weather(race.laps, weather_rows(race.timing), hot)
