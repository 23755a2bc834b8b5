"""Pit stops and stints: detection, timing, regulation minimum and margins.

`ticks` is the number of time ticks per second of the given data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexline.functions.ordered import has_hot_group, latest, medians, number, scan, total
from apexline.operators.timeline import TICKS_PER_SECOND

CAR = ["event", "car"]
LAP = ["event", "car", "lap"]

# Minimum standing seconds at the first stop after 1..10 laps.
FIRST_STOP_SECONDS = (64, 82, 101, 119, 138, 156, 175, 193, 212, 230)
LATER_STOP_LESS = 8
LAST_TABLE_MINUTES = 59
LANE_IN_CENTISECONDS = 842
HOLE_GUARD_SECONDS = 12
SAFETY_SECONDS = 2
REPAIR_SECONDS = 600


def pit_laps_inferred(
    legs: DataFrame, flagged: DataFrame, ticks: int = TICKS_PER_SECOND,
    hot_car: bool | None = None,
) -> DataFrame:
    """In-laps by flag, or by a first sector far over the car's median after them."""
    first = legs.filter("sector = 1").select(*LAP, F.expr("t1 - t0").alias("dur"))
    median = medians(first, CAR, "dur", ["lap"], "_m2", hot_car)
    slow = first.join(median, CAR).filter(
        (F.col("dur") * 4 > F.col("_m2") * 3) & (F.col("dur") * 2 - F.col("_m2") > 80 * ticks)
    )
    found = slow.select(*CAR, (F.col("lap") - 1).alias("lap")).filter("lap >= 1")
    both = found.withColumn("_found", F.lit(True)).join(
        flagged.select(*LAP).withColumn("_flag", F.lit(True)), LAP, "full"
    )
    return both.select(
        *LAP,
        F.when(F.col("_found") & F.col("_flag"), "both").when(F.col("_flag"), "flag")
        .otherwise("inferred").alias("source"),
    )


def pit_laps_no_last_sector(laps: DataFrame) -> DataFrame:
    """Completed laps that published no fifth sector: another lap follows, or the lap has a time."""
    last = laps.groupBy("event", "car").agg(F.max("lap").alias("_last"))
    silent = laps.filter(F.col("s")[4].isNull()).join(last, ["event", "car"])
    return silent.filter((F.col("lap") < F.col("_last")) | F.col("rt").isNotNull()).select(*LAP)


def detector_quality(detected: DataFrame, flagged: DataFrame) -> DataFrame:
    """Hits, false alarms and misses of a detector against the flag, per event."""
    joined = (
        detected.select(*LAP).distinct().withColumn("_d", F.lit(1))
        .join(flagged.select(*LAP).withColumn("_f", F.lit(1)), LAP, "full")
    )
    return joined.groupBy("event").agg(
        F.count_if(F.col("_d").isNotNull() & F.col("_f").isNotNull()).alias("tp"),
        F.count_if(F.col("_f").isNull()).alias("fp"),
        F.count_if(F.col("_d").isNull()).alias("fn"),
    )


def stints(laps: DataFrame, stops: DataFrame, hot_car: bool | None = None) -> DataFrame:
    """Stints between in-laps: length counted from the previous in-lap."""
    marked = laps.select(*LAP, "driver").join(
        stops.select(*LAP).distinct().withColumn("_in", F.lit(1).cast("bigint")), LAP, "left"
    )
    marked = marked.withColumn("_in_lap", F.when(F.col("_in") == 1, F.col("lap")))
    along = scan(
        marked, CAR, ["lap"],
        {"_before": total("_in", before=True), "_from": latest("_in_lap", before=True)}, hot_car,
    )
    numbered = along.withColumn("stint", F.coalesce("_before", F.lit(0)) + 1)
    return numbered.groupBy(*CAR, "stint").agg(
        F.min("lap").alias("first_lap"),
        F.max("lap").alias("last_lap"),
        (F.max("lap") - F.coalesce(F.max("_from"), F.lit(0))).alias("laps"),
        F.max_by("driver", "lap").alias("driver"),
        F.max("_in").isNotNull().alias("stopped"),
    )


def _out_lap_start(legs: DataFrame) -> DataFrame:
    """Start/finish crossing that closes a lap, and the sector that follows it."""
    return legs.filter("sector = 1").select(
        *CAR, (F.col("lap") - 1).alias("lap"), F.col("t0").alias("_line"),
        F.expr("t1 - t0").alias("_out_s1"),
    )


def pit_entry_time(
    stops: DataFrame, legs: DataFrame, ticks: int = TICKS_PER_SECOND
) -> DataFrame:
    """Start of the stop clock: the real pit entry, else back-dated from the line.

    stops: event, car, lap, pit_in.
    """
    derived = F.col("_line") - LANE_IN_CENTISECONDS * ticks // 100
    return stops.join(_out_lap_start(legs), LAP, "left").select(
        *LAP,
        F.coalesce("pit_in", derived).alias("anchor"),
        F.col("pit_in").isNotNull().alias("is_real"),
    )


def green_medians(laps: DataFrame, hot_car: bool | None = None) -> DataFrame:
    """Twice the medians of first (g1) and fifth (g5) sector over a car's green laps."""
    green = laps.filter("pit_status = 'N'").select(
        *LAP, F.col("s")[0].alias("v1"), F.col("s")[4].alias("v5")
    )
    if hot_car is None:
        hot_car = has_hot_group(green, CAR)
    if hot_car:
        first = medians(green, CAR, "v1", ["lap"], "g1", True)
        return first.join(medians(green, CAR, "v5", ["lap"], "g5", True), CAR, "full")

    def doubled(col):
        return F.round(F.percentile(col, 0.5) * 2).cast("bigint")

    return green.groupBy(*CAR).agg(doubled("v1").alias("g1"), doubled("v5").alias("g5"))


def _holes(stops: DataFrame, legs: DataFrame) -> DataFrame:
    fourth = legs.filter("sector = 4").select(*LAP, F.col("t1").alias("_s4_end"))
    return (
        stops.join(fourth, LAP, "left")
        .join(_out_lap_start(legs), LAP, "left")
        .withColumn("hole", F.col("_line") - F.col("_s4_end"))
    )


def anchor_guard(
    stops: DataFrame, legs: DataFrame, green: DataFrame, ticks: int = TICKS_PER_SECOND
) -> DataFrame:
    """Stops whose S4-to-line hole exceeds the car's green S5 by too much.

    green: as of green_medians.
    """
    over = F.col("hole") * 2 - F.col("g5") > 2 * HOLE_GUARD_SECONDS * ticks
    return _holes(stops.select(*LAP), legs).join(green, CAR, "left").select(
        *LAP, "hole", F.coalesce(over, F.lit(False)).alias("guarded")
    )


def stopped_estimate(stops: DataFrame, legs: DataFrame, green: DataFrame) -> DataFrame:
    """Standing time: measured, else what hole and out-lap hold over green pace.

    stops: event, car, lap, pit_dur. Both figures are kept for the error budget.
    """
    full = _holes(stops.select(*LAP, "pit_dur"), legs).join(green, CAR, "left")
    estimate = (
        (F.col("hole") + F.col("_out_s1")) * 2 - F.col("g5") - F.col("g1")
    ) / 2
    return full.select(
        *LAP,
        F.coalesce(F.col("pit_dur").cast("double"), estimate).alias("stopped"),
        F.col("pit_dur").isNotNull().alias("is_real"),
        estimate.alias("estimate"),
    )


def race_end(
    events: DataFrame, overrides: DataFrame, windows: DataFrame, schedule: DataFrame,
    ticks: int = TICKS_PER_SECOND,
) -> DataFrame:
    """End of race per event: override, own race window, same-day schedule row,
    else four hours after the start floored to a quarter hour.

    events: event, event_date, start; overrides: event, ts; windows: event, ts;
    schedule: event_date, ts.
    """
    quarter = 900 * ticks
    derived = F.call_function("div", F.col("start"), F.lit(quarter)) * quarter + 14_400 * ticks
    return (
        events.join(overrides.select("event", F.col("ts").alias("_o")), "event", "left")
        .join(windows.select("event", F.col("ts").alias("_w")), "event", "left")
        .join(schedule.select("event_date", F.col("ts").alias("_s")), "event_date", "left")
        .select(
            "event", "event_date",
            F.coalesce("_o", "_w", "_s", derived).alias("race_end"),
            F.when(F.col("_o").isNotNull(), "override").when(F.col("_w").isNotNull(), "window")
            .when(F.col("_s").isNotNull(), "schedule").otherwise("derived").alias("source"),
        )
    )


def minimum_stop(
    stops: DataFrame, last_hour: DataFrame, ticks: int = TICKS_PER_SECOND
) -> DataFrame:
    """Regulation minimum of each stop, in seconds, and the table it comes from.

    stops: event, car, lap, stop (1, 2, ...), laps (in the stint), anchor,
    race_end; last_hour: minutes, seconds.
    """
    first = F.array(*[F.lit(x) for x in FIRST_STOP_SECONDS])
    minutes = F.greatest(
        F.lit(1).cast("bigint"),
        -F.floor((F.col("anchor") - F.col("race_end")) / (60 * ticks)),
    )
    timed = stops.withColumn("_minutes", minutes)
    late = F.coalesce(F.col("_minutes") <= LAST_TABLE_MINUTES, F.lit(False))
    by_laps = F.element_at(first, F.least(F.col("laps"), F.lit(10)).cast("int"))
    looked_up = timed.join(
        last_hour.select(F.col("minutes").alias("_minutes"), F.col("seconds").alias("_c")),
        "_minutes", "left",
    )
    return looked_up.select(
        *stops.columns,
        F.when(late, F.col("_c"))
        .when(F.col("stop") == 1, by_laps)
        .otherwise(by_laps - LATER_STOP_LESS).cast("bigint").alias("minimum"),
        F.when(late, "C").when(F.col("stop") == 1, "A").otherwise("B").alias("table"),
    )


def stop_margin(stops: DataFrame, ticks: int = TICKS_PER_SECOND) -> DataFrame:
    """Standing time over the minimum, per stop; repairs have none.

    stops: ..., stopped (ticks), minimum (seconds).
    """
    repair = F.coalesce(F.col("stopped") > REPAIR_SECONDS * ticks, F.lit(False))
    return stops.withColumns(
        {
            "repair": repair,
            "margin": F.when(~repair, F.col("stopped") - F.col("minimum") * ticks),
        }
    )


def margin_totals(margins: DataFrame, ticks: int = TICKS_PER_SECOND) -> DataFrame:
    """Per car: standing time, floor, time given away, repairs and estimated stops."""
    counted = F.col("margin").isNotNull()
    return margins.groupBy("event", "klass", "car").agg(
        F.count_if(counted).alias("stops"),
        F.sum(F.when(counted, F.col("stopped"))).alias("stopped"),
        F.sum(F.when(counted, F.col("minimum") * ticks)).alias("floor"),
        F.sum("margin").alias("given_away"),
        F.count_if("repair").alias("repairs"),
        F.count_if(~F.col("is_real") & ~F.col("repair")).alias("estimated"),
    )


def _measured(totals: DataFrame) -> DataFrame:
    return totals.filter("estimated = 0 and stops > 0").select(
        "event", "klass", "car", "given_away",
        F.when(F.col("given_away") < 0, "under").otherwise("over").alias("side"),
    )


def margin_extremes(totals: DataFrame, ends: int = 5) -> DataFrame:
    """Cars furthest under the minimum and closest over it, in the measured field."""
    along = Window.partitionBy("event", "side").orderBy("given_away", F.length("car"), "car")
    return (
        _measured(totals)
        .withColumn("place", F.row_number().over(along))
        .filter(F.col("place") <= ends)
    )


def margin_callouts(totals: DataFrame) -> DataFrame:
    """For each class the furthest car under and the tightest over: of the class
    when two of its cars have stopped, else of the whole field."""
    measured = _measured(totals)
    best = F.min(F.struct("given_away", F.length("car").alias("n"), "car")).alias("x")
    of_class = measured.groupBy("event", "klass", "side").agg(best)
    of_field = measured.groupBy("event", "side").agg(best)
    scope = totals.groupBy("event", "klass").agg(
        (F.count_if(F.col("stops") > 0) >= 2).alias("_own")
    )
    own = scope.filter("_own").join(of_class, ["event", "klass"])
    other = scope.filter("not _own").join(of_field, "event")
    return own.unionByName(other).select(
        "event", "klass", "side", F.when(F.col("_own"), "class").otherwise("field").alias("scope"),
        F.col("x.car").alias("car"), F.col("x.given_away").alias("given_away"),
    )


def release_time(
    stops: DataFrame, at: int | Column, ticks: int = TICKS_PER_SECOND, offset: int = 0
) -> DataFrame:
    """When the car may go, and what is left of the wait at T."""
    due = F.col("anchor") + (F.col("minimum") + SAFETY_SECONDS) * ticks + offset
    now = at if isinstance(at, Column) else F.lit(at)
    return stops.select(*LAP, "minimum", due.alias("release"), (due - now).alias("remaining"))


def position_if_clean(
    laps: DataFrame, dim: DataFrame, totals: DataFrame, hot_field: bool | None = None
) -> DataFrame:
    """Final places as they are and without the time given away in the pits.

    Order is by laps, then time at the last lap's end. Only cars whose stops
    were all measured are asked about; all cars are counted. Each question is a
    probe sorted among the finishers, so no pair of cars is formed.
    """
    final = laps.groupBy(*CAR).agg(
        F.max("lap").alias("done"), F.max_by("tend", "lap").cast("double").alias("t")
    ).join(dim.select(*CAR, "klass"), CAR)
    asked = final.join(
        totals.filter("estimated = 0 and stops > 0").select(*CAR, "given_away"), CAR
    )
    saved = F.greatest(F.col("given_away"), F.lit(0.0))
    probes = asked.select(
        "event", "klass", "car", "done",
        F.explode(
            F.array(
                F.struct(F.col("t").alias("t"), F.lit("actual").alias("kind")),
                F.struct((F.col("t") - saved).alias("t"), F.lit("clean").alias("kind")),
            )
        ).alias("x"),
    ).select("event", "klass", "car", "done", "x.t", "x.kind", F.lit(0).cast("bigint").alias("n"))
    field = final.select(
        "event", "klass", "car", "done", "t", F.lit("z").alias("kind"),
        F.lit(1).cast("bigint").alias("n"),
    )
    line = field.unionByName(probes).withColumn("_less", -F.col("done"))
    # "z" sorts last: a finisher at the probe's own time is not ahead of it.
    order = ["_less", "t", "kind", "car"]
    overall = scan(line, ["event"], order, {"_all": total("n", before=True)}, hot_field)
    both = scan(overall, ["event", "klass"], order, {"_cls": total("n", before=True)}, hot_field)

    def place(kind, col):
        ahead = F.when(F.col("kind") == kind, F.coalesce(F.col(col), F.lit(0)) + 1)
        return F.max(ahead)

    return both.filter("kind <> 'z'").groupBy("event", "klass", "car").agg(
        place("actual", "_cls").alias("class_actual"), place("clean", "_cls").alias("class_possible"),
        place("actual", "_all").alias("overall_actual"),
        place("clean", "_all").alias("overall_possible"),
    )


def error_quantiles(errors: DataFrame, hot: bool | None = None) -> DataFrame:
    """Nearest-rank median, p90, p95 and maximum of `error` per `kind`."""
    known = errors.filter("error is not null").select("kind", "error", *LAP)
    sizes = known.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    ranked = scan(known, ["kind"], ["error", *LAP], {"_i": number()}, hot).join(sizes, "kind")

    def at(percent):
        index = F.expr(f"(n * {percent} + 99) div 100")
        return F.max(F.when(F.col("_i") == index, F.col("error")))

    return ranked.groupBy("kind").agg(
        F.max("n").alias("n"), at(50).alias("median"), at(90).alias("p90"), at(95).alias("p95"),
        at(100).alias("max"),
    )
