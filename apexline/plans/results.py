"""Result, championship and schedule queries."""

from functools import cached_property

from pyspark.sql import functions as F

from apexline.functions.ordered import has_hot_group, number, scan
from apexline.functions.session import fresh_dir
from apexline.operators import results
from apexline.plans.pits import meetings
from apexline.plans.registry import part, query, sql
from apexline.sources.tables import table


class Season:
    """Results read from orders: a customer drives, three customers share a car."""

    def __init__(self, spark, folder, daily=False):
        self.spark, self.folder, self.daily = spark, folder, daily

    @cached_property
    def drives(self):
        orders = table(self.spark, self.folder, "orders")
        date = F.to_date("o_orderdate")
        event = date if self.daily else F.trunc(date, "quarter")
        return orders.select(
            event.cast("string").alias("event_date"),
            F.expr("o_custkey div 3").alias("car_no"),
            F.col("o_custkey"), F.col("o_orderkey"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        )

    @cached_property
    def hot_event(self):
        return has_hot_group(self.drives.select("event_date", "car_no").distinct(), ["event_date"])

    @cached_property
    def cars(self):
        scored = self.drives.groupBy("event_date", "car_no").agg(
            F.sum("cents").alias("score"), F.min("o_orderkey").alias("mark")
        )
        status = (
            F.when(F.col("mark") % 7 == 0, "dnf").when(F.col("mark") % 11 == 0, "dsq")
            .otherwise("classified")
        )
        ranked = scored.withColumns({"status": status, "_less": -F.col("score")})
        placed = scan(
            ranked.withColumn("_out", (F.col("status") != "classified").cast("int")),
            ["event_date", "_out"], ["_less", "car_no"], {"_n": number()}, self.hot_event,
        )
        return placed.select(
            "event_date", "car_no", "status",
            F.when(F.col("_out") == 0, F.col("_n")).alias("pos_overall"),
        )

    @cached_property
    def results(self):
        drivers = self.drives.select("event_date", "car_no", "o_custkey").distinct()
        names = table(self.spark, self.folder, "customer").join(
            table(self.spark, self.folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        rating = (
            F.when(F.col("car_no") % 3 == 0, "PRO-AM").when(F.col("car_no") % 3 == 1, "AM")
        )
        base = F.concat(F.lit("SP"), F.col("car_no") % 9)
        joined = drivers.join(names, F.col("o_custkey") == F.col("c_custkey")).join(
            self.cars, ["event_date", "car_no"]
        )
        day = F.unix_date(F.to_date("event_date")).cast("bigint")
        return joined.select(
            "event_date", "car_no", base.alias("class"), rating.alias("rating"),
            F.concat_ws(" ", base, rating).alias("class_full"),
            F.when(F.col("car_no") % 8 != 0, F.concat(F.lit("Team "), F.col("car_no") % 7)).alias(
                "team"
            ),
            F.concat(F.lit("Model "), (F.col("car_no") + F.year("event_date")) % 5).alias(
                "car_model"
            ),
            F.lower("c_name").alias("driver_key"),
            F.col("c_name").alias("driver_name"),
            F.when(F.col("o_custkey") % 10 != 0, F.concat("n_name", F.year("event_date"))).alias(
                "nationality"
            ),
            "pos_overall",
            (480_000 + (F.col("o_custkey") * 7919 + day) % 60_000).alias("best_lap_ms"),
            "status",
        )

    @cached_property
    def ranked(self):
        return results.class_rank(self.results, self.hot_event)

    @cached_property
    def races(self):
        quarter = F.quarter("event_date")
        return self.drives.select("event_date").distinct().filter(quarter != 3).select(
            "event_date", F.concat(F.lit("R"), quarter).alias("round_no"),
            F.concat(F.lit("Race "), "event_date").alias("title"), F.lit("S1").alias("series"),
            (F.year("event_date") % 2 == 0).alias("has_results"),
            (F.month("event_date") - 1).cast("bigint").alias("driver_rows"),
        )

    @cached_property
    def grid(self):
        """Starting order by the best account balance among a car's drivers."""
        best = self.drives.select("event_date", "car_no", "o_custkey").distinct().join(
            table(self.spark, self.folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
        ).groupBy("event_date", "car_no").agg(F.max("c_acctbal").alias("b"))
        base = F.concat(F.lit("SP"), F.col("car_no") % 9)
        keyed = best.withColumns({"_less": -F.col("b"), "class": base})
        overall = scan(
            keyed, ["event_date"], ["_less", "car_no"], {"pos_overall": number()}, self.hot_event
        )
        return scan(
            overall, ["event_date", "class"], ["_less", "car_no"], {"pos_class": number()},
            self.hot_event,
        ).select("event_date", "car_no", "class", "pos_overall", "pos_class")


def _season_parts(prefix: str, event: str) -> None:
    part(
        f"{prefix}drive",
        f"""
SELECT CAST(CAST({event} AS DATE) AS VARCHAR) AS event_date, o_custkey // 3 AS car_no, o_custkey, o_orderkey,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders""",
    )
    part(
        f"{prefix}car",
        f"""
SELECT event_date, car_no, status, CASE WHEN status = 'classified' THEN row_number() OVER (
  PARTITION BY event_date, status = 'classified' ORDER BY score DESC, car_no) END AS pos_overall
FROM (SELECT event_date, car_no, sum(cents) AS score, CASE WHEN min(o_orderkey) % 7 = 0 THEN 'dnf'
  WHEN min(o_orderkey) % 11 = 0 THEN 'dsq' ELSE 'classified' END AS status
  FROM {prefix}drive GROUP BY event_date, car_no)""",
        f"{prefix}drive",
    )
    part(
        f"{prefix}result0",
        f"""
SELECT event_date, car_no, 'SP' || (car_no % 9) AS class,
  CASE car_no % 3 WHEN 0 THEN 'PRO-AM' WHEN 1 THEN 'AM' END AS rating,
  'SP' || (car_no % 9) || CASE car_no % 3 WHEN 0 THEN ' PRO-AM' WHEN 1 THEN ' AM' ELSE '' END AS class_full,
  CASE WHEN car_no % 8 <> 0 THEN 'Team ' || (car_no % 7) END AS team,
  'Model ' || ((car_no + year(CAST(event_date AS DATE))) % 5) AS car_model, lower(c_name) AS driver_key,
  c_name AS driver_name,
  CASE WHEN o_custkey % 10 <> 0 THEN n_name || year(CAST(event_date AS DATE)) END AS nationality, pos_overall,
  480000 + (o_custkey * 7919 + (CAST(event_date AS DATE) - DATE '1970-01-01')) % 60000 AS best_lap_ms, status
FROM (SELECT DISTINCT event_date, car_no, o_custkey FROM {prefix}drive)
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN {prefix}car USING (event_date, car_no)""",
        f"{prefix}drive", f"{prefix}car",
    )


_season_parts("", "date_trunc('quarter', o_orderdate)")
_season_parts("daily_", "o_orderdate")
part(
    "result",
    """
SELECT r.*, c.n AS pos_class FROM result0 r LEFT JOIN (
  SELECT event_date, class, car_no, row_number() OVER (PARTITION BY event_date, class
    ORDER BY pos_overall, car_no) AS n
  FROM (SELECT DISTINCT event_date, class, car_no, pos_overall FROM result0 WHERE pos_overall IS NOT NULL)) c
USING (event_date, class, car_no)""",
    "result0",
)
part(
    "race",
    """
SELECT event_date, 'R' || quarter(CAST(event_date AS DATE)) AS round_no, 'Race ' || event_date AS title,
  'S1' AS series, year(CAST(event_date AS DATE)) % 2 = 0 AS has_results,
  month(CAST(event_date AS DATE)) - 1 AS driver_rows
FROM (SELECT DISTINCT event_date FROM drive) WHERE quarter(CAST(event_date AS DATE)) <> 3""",
    "drive",
)
part(
    "grid",
    """
SELECT event_date, car_no, class, row_number() OVER (PARTITION BY event_date ORDER BY b DESC, car_no) AS pos_overall,
  row_number() OVER (PARTITION BY event_date, class ORDER BY b DESC, car_no) AS pos_class
FROM (SELECT event_date, car_no, 'SP' || (car_no % 9) AS class, max(c_acctbal) AS b
  FROM drive JOIN customer ON c_custkey = o_custkey GROUP BY ALL)""",
    "drive",
)
part(
    "champ",
    """
SELECT c.event_date, r.round_no, r.title, r.series, c.class, c.class[1:8] AS class_key,
  row_number() OVER (PARTITION BY c.event_date, c.class ORDER BY c.pos_overall IS NULL, c.pos_overall, c.car_no)
    AS index, c.car_no, c.pos_overall, c.status
FROM (SELECT event_date, car_no, coalesce(class_full, class) AS class, pos_overall, status FROM result
  QUALIFY row_number() OVER (PARTITION BY event_date, car_no ORDER BY pos_overall IS NULL, pos_overall) = 1) c
LEFT JOIN race r USING (event_date)""",
    "result", "race",
)


@query(
    "class_rank",
    sql("SELECT event_date, class, car_no, driver_key, pos_overall, pos_class FROM result", "result"),
)
def _(spark, folder):
    return Season(spark, folder).ranked.select(
        "event_date", "class", "car_no", "driver_key", "pos_overall", "pos_class"
    )


part(
    "gate",
    """
SELECT event_date, count(DISTINCT car_no) AS cars, count(*) AS driver_rows,
  count(DISTINCT car_no) < 5 OR count(*) > count(DISTINCT car_no) * 6 AS bad
FROM daily_result0 GROUP BY event_date""",
    "daily_result0",
)


@query(
    "sheet_sanity_gate",
    sql(
        "SELECT event_date, car_no, driver_key FROM daily_result0 JOIN gate USING (event_date)"
        " WHERE NOT bad",
        "daily_result0", "gate",
    ),
)
def _(spark, folder):
    accepted, _ = results.sheet_sanity_gate(Season(spark, folder, daily=True).results)
    return accepted.select("event_date", "car_no", "driver_key")


@query(
    "sheet_sanity_rejects",
    sql("SELECT event_date, cars, driver_rows FROM gate WHERE bad", "gate"),
)
def _(spark, folder):
    return results.sheet_sanity_gate(Season(spark, folder, daily=True).results)[1]


@query(
    "grid_sanity_gate",
    sql(
        "SELECT event_date, car_no FROM (SELECT DISTINCT event_date, car_no FROM daily_drive)"
        " QUALIFY count(*) OVER (PARTITION BY event_date) >= 5",
        "daily_drive",
    ),
)
def _(spark, folder):
    grid = Season(spark, folder, daily=True).drives.select("event_date", "car_no").distinct()
    return results.grid_sanity_gate(grid)


@query(
    "pending_rounds",
    sql(
        """
SELECT DISTINCT event_date FROM drive d WHERE event_date <= '2000-12-31' AND NOT EXISTS (
  SELECT 1 FROM race r WHERE r.event_date = d.event_date AND has_results AND driver_rows > 0)""",
        "drive", "race",
    ),
)
def _(spark, folder):
    season = Season(spark, folder)
    return results.pending_rounds(season.drives, season.races, "2000-12-31")


@query(
    "replace_event",
    sql(
        """
SELECT event_date, car_no, driver_key, status FROM result0 WHERE year(CAST(event_date AS DATE)) < 1998
UNION ALL SELECT event_date, car_no, driver_key, 'again' FROM result0
WHERE year(CAST(event_date AS DATE)) >= 1998 AND status = 'classified'""",
        "result0",
    ),
)
def _(spark, folder):
    held = Season(spark, folder).results.select("event_date", "car_no", "driver_key", "status")
    parsed = held.filter("year(event_date) >= 1998 and status = 'classified'").withColumn(
        "status", F.lit("again")
    )
    # The table is written, and the parsed events twice over theirs, as in a run after a failed one.
    path = fresh_dir(spark, "season-results")
    for rows in (held, parsed, parsed):
        results.replace_event(rows, path)
    return spark.read.schema(held.schema).parquet(path)


@query(
    "driver_stats",
    sql(
        """
SELECT driver_key, max(driver_name) AS driver_name,
  arg_max(nationality, event_date || nationality) FILTER (nationality IS NOT NULL) AS nationality,
  count(DISTINCT event_date) AS races,
  count(DISTINCT event_date) FILTER (pos_overall BETWEEN 1 AND 3) AS podiums_overall,
  count(DISTINCT event_date) FILTER (pos_class BETWEEN 1 AND 3) AS podiums_class,
  min(pos_overall) AS best_pos_overall, min(pos_class) AS best_pos_class, min(best_lap_ms) AS best_lap_ms,
  count(DISTINCT car_model) AS distinct_cars, count(DISTINCT team) AS distinct_teams
FROM result GROUP BY driver_key""",
        "result",
    ),
)
def _(spark, folder):
    return results.driver_stats(Season(spark, folder).ranked)


def _champ(season):
    return results.championship_rounds(season.ranked, season.races, season.hot_event)


@query("championship_rounds", sql("SELECT * FROM champ", "champ"))
def _(spark, folder):
    return _champ(Season(spark, folder))


@query(
    "position_by_index",
    sql("SELECT event_date, class, car_no, index AS position, status FROM champ", "champ"),
)
def _(spark, folder):
    return results.position_by_index(_champ(Season(spark, folder)))


@query(
    "class_key_join",
    sql(
        """
SELECT a.class, a.cars, b.class AS class_other, b.starters, a.class[1:8] AS class_key
FROM (SELECT class, count(*) AS cars FROM champ GROUP BY class) a
JOIN (SELECT class_full[1:8] AS class, count(DISTINCT car_no) AS starters FROM result GROUP BY ALL) b
ON a.class[1:8] = b.class[1:8]""",
        "champ", "result",
    ),
)
def _(spark, folder):
    season = Season(spark, folder)
    full = _champ(season).groupBy("class").agg(F.count(F.lit(1)).alias("cars"))
    short = (
        season.results.groupBy(results.class_key("class_full").alias("class"))
        .agg(F.count_distinct("car_no").alias("starters"))
    )
    return results.class_key_join(full, short)


@query(
    "grid_vs_finish",
    sql(
        """
SELECT g.event_date, g.car_no, g.pos_overall AS start, g.pos_class AS start_class, r.finish, r.finish_class,
  g.pos_overall - r.finish AS gained, g.pos_class - r.finish_class AS gained_class
FROM grid g JOIN (SELECT event_date, car_no, min(pos_overall) AS finish, min(pos_class) AS finish_class
  FROM result GROUP BY ALL) r USING (event_date, car_no)""",
        "grid", "result",
    ),
)
def _(spark, folder):
    season = Season(spark, folder)
    return results.grid_vs_finish(season.grid, season.ranked)


# ---- schedule --------------------------------------------------------------


def sessions(spark, folder):
    days = meetings(spark, folder)
    day = F.col("day")

    def row(label, start, end, at):
        return F.struct(
            F.lit(label).alias("label"), F.lit(start).alias("start"), F.lit(end).alias("end"),
            F.lit(at).alias("at"),
        )

    rows = F.array_compact(
        F.array(
            F.when(day % 11 != 0, row("quali", "8:30", "10:00", 1)),
            F.when(day % 3 == 0, row("quali", "08:45", None, 2)),
            F.when(day % 11 == 0, row("quali", "x:30", "10:00", 3)),
            F.when(day % 4 != 0, row("race", "12:00", "16:00", 4)),
        )
    )
    return days.select("event_date", F.explode(rows).alias("r")).select("event_date", "r.*")


def _last_sunday(month: int) -> str:
    return (
        f"(make_date(year(d), {month}, 31) - CAST(dayofweek(make_date(year(d), {month}, 31)) AS INTEGER))"
    )


_UTC = (
    "epoch_ms(d) + {clock} - CASE WHEN d >= " + _last_sunday(3) + " AND d < " + _last_sunday(10)
    + " THEN 7200000 ELSE 3600000 END"
)
part(
    "window",
    f"""
SELECT event_date, label, {_UTC.format(clock='start_ms')} AS start_ts, {_UTC.format(clock='end_ms')} AS end_ts
FROM (SELECT event_date, CAST(event_date AS DATE) AS d, day, label, start_ms, end_ms FROM meeting,
  (VALUES ('quali', 30600000, 36000000, 1), ('quali', 31500000, NULL, 2), ('race', 43200000, 57600000, 4))
    v(label, start_ms, end_ms, n)
  WHERE (n = 1 AND day % 11 <> 0 AND day % 3 <> 0) OR (n = 2 AND day % 3 = 0) OR n = 4) WHERE day % 4 <> 0""",
    "meeting",
)


@query("session_windows", sql('SELECT * FROM "window"', "window"))
def _(spark, folder):
    return results.session_windows(sessions(spark, folder))


@query(
    "day_before_windows",
    sql(
        f"""
SELECT event_date, 'practice' AS label, {_UTC.format(clock='25200000')} AS start_ts,
  {_UTC.format(clock='68400000')} AS end_ts
FROM (SELECT CAST(CAST(event_date AS DATE) - 1 AS VARCHAR) AS event_date, CAST(event_date AS DATE) - 1 AS d
  FROM (SELECT DISTINCT event_date FROM drive UNION SELECT DISTINCT event_date FROM meeting WHERE day % 5 = 0))
WHERE event_date NOT IN (SELECT event_date FROM drive UNION SELECT event_date FROM meeting WHERE day % 5 = 0)""",
        "drive", "meeting",
    ),
)
def _(spark, folder):
    quarters = Season(spark, folder).drives.select("event_date").distinct()
    fifths = meetings(spark, folder).filter("day % 5 = 0").select("event_date")
    return results.day_before_windows(quarters.union(fifths))


@query(
    "in_session",
    sql(
        """
SELECT o_orderkey, ts, EXISTS (SELECT 1 FROM "window" w WHERE ts >= w.start_ts - 600000
  AND ts <= coalesce(w.end_ts, w.start_ts) + 900000) AS in_session
FROM (SELECT o_orderkey, epoch_ms(o_orderdate) + (o_orderkey * 7919) % 86400 * 1000 AS ts FROM orders)""",
        "window",
    ),
)
def _(spark, folder):
    day = F.unix_date(F.to_date("o_orderdate")).cast("bigint") * 86_400_000
    instants = table(spark, folder, "orders").select(
        "o_orderkey", (day + (F.col("o_orderkey") * 7919) % 86_400 * 1000).alias("ts")
    )
    return results.in_session(instants, results.session_windows(sessions(spark, folder)))
