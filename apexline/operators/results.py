"""Results, grids, championship and session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.ordered import highest, number, scan, total
from apexline.functions.session import cut

# Sanity limits of a well-formed sheet, session padding, key length.
FEWEST_CARS = 5
MOST_DRIVERS = 6
FEWEST_GRID_ROWS = 5
PAD_BEFORE_MIN, PAD_AFTER_MIN = 10, 15
CLASS_KEY_LENGTH = 8
DAY_MS = 86_400_000


def class_rank(results: DataFrame, hot: bool | None = None) -> DataFrame:
    """Classified cars ranked in their base class by overall place."""
    cars = (
        results.filter("pos_overall is not null")
        .groupBy("event_date", "class", "car_no")
        .agg(F.min("pos_overall").alias("_pos"))
    )
    ranked = scan(
        cars, ["event_date", "class"], ["_pos", "car_no"], {"_rank": number()}, hot
    ).drop("_pos")
    placed = results.join(ranked, ["event_date", "class", "car_no"], "left")
    return placed.withColumn(
        "pos_class", F.when(F.col("pos_overall").isNotNull(), F.col("_rank"))
    ).drop("_rank")


def sheet_sanity_gate(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of well-formed events, and the events turned away with their counts."""
    cars = (
        results.groupBy("event_date", "car_no").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("event_date")
        .agg(F.count(F.lit(1)).alias("cars"), F.sum("n").alias("driver_rows"))
    )
    bad = (F.col("cars") < FEWEST_CARS) | (F.col("driver_rows") > F.col("cars") * MOST_DRIVERS)
    rejects = cars.filter(bad)
    return results.join(rejects.select("event_date"), "event_date", "left_anti"), rejects


def grid_sanity_gate(grid: DataFrame) -> DataFrame:
    """Grid rows of events with enough of them."""
    rows = grid.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))
    enough = rows.filter(F.col("n") >= FEWEST_GRID_ROWS).select("event_date")
    return grid.join(enough, "event_date", "left_semi")


def attach_best_lap(drivers: DataFrame, laps: DataFrame) -> DataFrame:
    """Each driver's own best lap by list order, else the car's; who set it.

    drivers: event_date, car_no, at (1, 2, ...), first_lap_ms; laps: event_date,
    car_no, driver_no, ms.
    """
    own = laps.select("event_date", "car_no", F.col("driver_no").alias("at"), F.col("ms"))
    fastest = laps.groupBy("event_date", "car_no").agg(F.min("ms").alias("_car_ms"))
    joined = drivers.join(own, ["event_date", "car_no", "at"], "left").join(
        fastest, ["event_date", "car_no"], "left"
    )
    return joined.withColumns(
        {
            "best_lap_ms": F.coalesce("ms", "first_lap_ms"),
            "set_fastest": F.when(F.col("ms").isNotNull(), F.col("ms") == F.col("_car_ms")),
        }
    ).drop("ms", "_car_ms")


def pending_rounds(
    rounds: DataFrame, races: DataFrame, today: str, force: bool = False
) -> DataFrame:
    """Past dates not ingested yet, newest first."""
    past = rounds.filter(F.col("event_date") <= today).select("event_date").distinct()
    if not force:
        done = races.filter("has_results and driver_rows > 0").select("event_date")
        past = past.join(done, "event_date", "left_anti")
    return past.orderBy(F.desc("event_date"))


def replaced_rows(held: DataFrame, parsed: DataFrame) -> DataFrame:
    """Held rows with every parsed event's rows in place of its old ones."""
    fresh = parsed.select("event_date").distinct()
    return held.join(fresh, "event_date", "left_anti").unionByName(parsed)


def replace_event(parsed: DataFrame, path: str) -> None:
    """Write parsed rows over their event partitions; other events stay.

    Rows are brought together by event first, so that an event is few files; large ones stay split.
    """
    (
        parsed.hint("rebalance", "event_date").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )


def driver_stats(results: DataFrame) -> DataFrame:
    """Career figures per driver; the latest known nationality."""

    def podium(col):
        return F.count_if(F.col(f"on_{col}"))

    figures = [
        F.max("driver_name").alias("driver_name"),
        F.max("nationality").alias("nationality"),
        *[F.max(f"on_{c}").alias(f"on_{c}") for c in ("pos_overall", "pos_class")],
        *[F.min(c).alias(c) for c in ("pos_overall", "pos_class", "best_lap_ms")],
    ]
    # One row per driver, event, car and team, written down: the results are derived once, and what follows
    # counts rows of it in two levels, so that nothing is made distinct over the results themselves.
    flagged = results.withColumns({f"on_{c}": F.col(c).between(1, 3) for c in ("pos_overall", "pos_class")})
    drives = cut(flagged.groupBy("driver_key", "event_date", "car_model", "team").agg(*figures))
    raced = drives.groupBy("driver_key", "event_date").agg(*figures)
    latest = F.when(F.col("nationality").isNotNull(), F.struct("event_date", "nationality"))
    figures = raced.groupBy("driver_key").agg(
        F.max("driver_name").alias("driver_name"),
        F.max(latest)["nationality"].alias("nationality"),
        F.count("event_date").alias("races"),
        podium("pos_overall").alias("podiums_overall"),
        podium("pos_class").alias("podiums_class"),
        F.min("pos_overall").alias("best_pos_overall"),
        F.min("pos_class").alias("best_pos_class"),
        F.min("best_lap_ms").alias("best_lap_ms"),
    )
    for source, name in (("car_model", "distinct_cars"), ("team", "distinct_teams")):
        values = drives.select("driver_key", source).distinct()
        counts = values.groupBy(F.col("driver_key").alias("_driver")).agg(F.count(source).alias(name))
        figures = figures.join(counts, F.col("driver_key").eqNullSafe(F.col("_driver"))).drop("_driver")
    return figures


def class_key(col):
    return F.substring(col, 1, CLASS_KEY_LENGTH)


def championship_rounds(
    results: DataFrame, races: DataFrame, hot: bool | None = None
) -> DataFrame:
    """Per event and full class, its cars in finishing order, one row per car.

    Unclassified cars come last; `index` counts from 1 and is the class place.
    """
    best = results.groupBy("event_date", "car_no").agg(
        F.min(
            F.struct(
                F.col("pos_overall").isNull().alias("out"), "pos_overall",
                F.coalesce("class_full", "class").alias("klass"), "status",
            )
        ).alias("x")
    )
    cars = best.select(
        "event_date", "car_no", "x.out", "x.pos_overall", F.col("x.klass").alias("class"),
        "x.status",
    ).filter("class is not null")
    ordered = scan(
        cars, ["event_date", "class"], ["out", "pos_overall", "car_no"], {"index": number()}, hot
    )
    return ordered.join(
        races.select("event_date", "round_no", "title", "series"), "event_date", "left"
    ).select(
        "event_date", "round_no", "title", "series", "class", class_key("class").alias("class_key"),
        "index", "car_no", "pos_overall", "status",
    )


def position_by_index(rounds: DataFrame) -> DataFrame:
    """Place in class from the order of the round's cars, not from the sheet."""
    return rounds.select(
        "event_date", "class", "car_no", F.col("index").alias("position"), "status"
    )


def class_key_join(left: DataFrame, right: DataFrame, column: str = "class") -> DataFrame:
    """Join sources whose class names agree in their first eight characters."""
    keyed = left.withColumn("class_key", class_key(column))
    other = right.withColumn("class_key", class_key(column)).withColumnRenamed(
        column, f"{column}_other"
    )
    return keyed.join(other, "class_key")


def grid_vs_finish(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Places won or lost from the grid to the flag, overall and in class."""
    cars = results.groupBy("event_date", "car_no").agg(
        F.min("pos_overall").alias("finish"), F.min("pos_class").alias("finish_class")
    )
    return grid.join(cars, ["event_date", "car_no"]).select(
        "event_date", "car_no",
        F.col("pos_overall").alias("start"), F.col("pos_class").alias("start_class"),
        "finish", "finish_class",
        (F.col("pos_overall") - F.col("finish")).alias("gained"),
        (F.col("pos_class") - F.col("finish_class")).alias("gained_class"),
    )


def _last_sunday(day, month: int):
    end = F.make_date(F.year(day), F.lit(month), F.lit(31))
    return F.next_day(F.date_sub(end, 7), "Sunday")


def berlin_ms(day, clock):
    """UTC instant in ms of a Berlin 'H:MM' on a day; null when malformed.

    Summer time is that of the whole day, by the rule in force since 1996:
    last Sunday of March to last Sunday of October.
    """
    date = F.to_date(day)
    minutes = F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("bigint") * 60 + F.split_part(
        clock, F.lit(":"), F.lit(2)
    ).try_cast("bigint")
    summer = (date >= _last_sunday(date, 3)) & (date < _last_sunday(date, 10))
    ahead = F.when(summer, 120).otherwise(60)
    instant = F.unix_date(date).cast("bigint") * DAY_MS + (minutes - ahead) * 60_000
    return F.when(clock.rlike(r"^\d{1,2}:\d{2}$"), instant)


def session_windows(sessions: DataFrame, required: tuple[str, ...] = ("race",)) -> DataFrame:
    """UTC windows, the last row of a (date, label) winning; an event is kept
    only with all its required labels.

    sessions: event_date, label, start, end (clock texts), at (reading order).
    """
    timed = sessions.select(
        "event_date", "label", "at",
        berlin_ms(F.col("event_date"), F.col("start")).alias("start_ts"),
        berlin_ms(F.col("event_date"), F.col("end")).alias("end_ts"),
    ).filter("start_ts is not null")
    last = timed.groupBy("event_date", "label").agg(
        F.max_by(F.struct("start_ts", "end_ts"), "at").alias("x")
    )
    kept = last
    if required:
        needed = last.filter(F.col("label").isin(*required))
        complete = needed.groupBy("event_date").agg(F.count(F.lit(1)).alias("n")).filter(
            F.col("n") == len(required)
        )
        kept = last.join(complete.select("event_date"), "event_date", "left_semi")
    return kept.select(
        "event_date", "label", "x.start_ts", "x.end_ts"
    )


def day_before_windows(rounds: DataFrame) -> DataFrame:
    """A 07:00-19:00 practice window before each race day that follows no other."""
    race_days = rounds.select("event_date").distinct()
    before = race_days.select(
        F.date_sub(F.to_date("event_date"), 1).cast("string").alias("event_date")
    )
    return before.join(race_days, "event_date", "left_anti").select(
        "event_date", F.lit("practice").alias("label"),
        berlin_ms(F.col("event_date"), F.lit("07:00")).alias("start_ts"),
        berlin_ms(F.col("event_date"), F.lit("19:00")).alias("end_ts"),
    )


def _merged_by_day(windows: DataFrame, hot: bool | None) -> DataFrame:
    """Padded windows on each day they touch, overlapping ones made one."""
    padded = windows.select(
        (F.col("start_ts") - PAD_BEFORE_MIN * 60_000).alias("_from"),
        (F.coalesce("end_ts", "start_ts") + PAD_AFTER_MIN * 60_000).alias("_to"),
    )
    laid = padded.withColumn(
        "_day", F.explode(F.expr(f"sequence(_from div {DAY_MS}, _to div {DAY_MS})"))
    ).distinct()
    reached = scan(laid, ["_day"], ["_from", "_to"], {"_upto": highest("_to", before=True)}, hot)
    opens = F.coalesce((F.col("_from") > F.col("_upto")).cast("bigint"), F.lit(1).cast("bigint"))
    islands = scan(
        reached.withColumn("_opens", opens), ["_day"], ["_from", "_to"],
        {"_island": total("_opens")}, hot,
    )
    return islands.groupBy("_day", "_island").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to")
    ).drop("_island")


def in_session(
    events: DataFrame, windows: DataFrame, time: str = "ts", hot_day: bool | None = None
) -> DataFrame:
    """Flag instants (ms) inside any window padded before and after.

    Windows are merged per day first, so an instant meets at most one.
    """
    merged = _merged_by_day(windows, hot_day)
    dated = events.withColumn("_day", F.expr(f"{time} div {DAY_MS}"))
    inside = (F.col(time) >= F.col("_from")) & (F.col(time) <= F.col("_to"))
    met = dated.join(merged, (dated["_day"] == merged["_day"]) & inside, "left")
    return met.select(*events.columns, F.col("_from").isNotNull().alias("in_session"))
