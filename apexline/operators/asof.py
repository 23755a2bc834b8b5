"""Questions at a clock time T. Every answer uses only what is known by T."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexline.functions.ordered import following, highest, lowest, number, scan, total
from apexline.functions.session import cut
from apexline.operators.timeline import TICKS_PER_SECOND

CAR = ["event", "car"]
SILENT_MS = 150_000
STALE_MS = 120_000
STOPPED_MS = 180_000
PARKED_TICKS = 360 * TICKS_PER_SECOND


def active_leg(legs: DataFrame, at: int) -> DataFrame:
    """The leg each car is on at T: the latest one begun, if not over yet."""
    begun = legs.filter(F.col("t0") <= at)
    latest = begun.groupBy(*CAR).agg(
        F.max(F.struct("t0", "lap", "sector", "t1", "speed")).alias("x")
    )
    return latest.select(*CAR, "x.lap", "x.sector", "x.t0", "x.t1").filter(F.col("t1") > at)


def _with_class(legs: DataFrame, dim: DataFrame) -> DataFrame:
    """Legs with their car's class, joined unless they carry it."""
    if "klass" in legs.columns:
        return legs
    return legs.join(dim.select(*CAR, "klass"), CAR)


def _progress(at) -> Column:
    length = F.coalesce(F.nullif(F.col("t1") - F.col("t0"), F.lit(0)), F.lit(1))
    done = (F.lit(at) if isinstance(at, int) else at) - F.col("t0")
    return F.col("lap") * 5 + (F.col("sector") - 1) + done / length


def _leg() -> Column:
    """Number of a leg along the race; all progress on it is from here to the next number."""
    return F.col("lap") * 5 + (F.col("sector") - 1)


def legs_in_use(spans: DataFrame, hot: bool | None = None) -> DataFrame:
    """When any car of the class was on a leg: event, klass, leg, and the times [since, until) that do not touch."""
    on_leg = spans.select("event", "klass", _leg().alias("leg"), "car", "t0", "until")
    key, order = ["event", "klass", "leg"], ["t0", "until", "car"]
    held = scan(on_leg, key, order, {"_held": highest("until", before=True)}, hot)
    opens = F.when(F.col("t0") <= F.col("_held"), 0).otherwise(1).cast("bigint")
    counted = scan(held.withColumn("_opens", opens), key, order, {"_run": total("_opens")}, hot)
    return counted.groupBy(*key, "_run").agg(F.min("t0").alias("since"), F.max("until").alias("until")).drop("_run")


def live_position(
    legs: DataFrame, dim: DataFrame, at: int, hot_class: bool | None = None
) -> DataFrame:
    """Place by progress among the cars of a class that are on a leg at T."""
    running = active_leg(legs, at).join(dim.select(*CAR, "klass"), CAR)
    ordered = running.withColumns({"_p": -_progress(at), "_len": F.length("car")})
    placed = scan(
        ordered, ["event", "klass"], ["_p", "_len", "car"], {"position": number()}, hot_class
    )
    return placed.select("event", "klass", "car", "lap", "sector", "position")


def common_gap(bounds: DataFrame, refs: DataFrame, at: int) -> DataFrame:
    """Gap of each reference car to its class rivals at the last timing point
    that both have passed by T; positive when the reference car came later."""
    known = bounds.filter(F.col("t") <= at)
    mine = known.join(refs.select(*CAR), CAR).select(
        "event", "klass", F.col("car").alias("ref"), "lap", "sector", F.col("t").alias("t_ref")
    )
    both = known.join(mine, ["event", "klass", "lap", "sector"]).filter("car <> ref")
    return both.groupBy("event", "klass", "ref", F.col("car").alias("other")).agg(
        F.max_by(F.col("t_ref") - F.col("t"), F.col("lap") * 5 + F.col("sector")).alias("gap")
    )


def gap_ahead_series(
    legs: DataFrame, bounds: DataFrame, refs: DataFrame, bucket: int,
    hot_car: bool | None = None,
) -> DataFrame:
    """At each boundary of a reference car: the car one place ahead and its gap.

    Legs meet the boundary times through time buckets and by their number: a question is met by the cars on
    its own leg and on the next leg in use, not by the whole class. Of the cars ahead only the nearest
    survives the partial aggregate.
    """
    dim = bounds.select(*CAR, "klass").distinct()
    spans = (
        scan(_with_class(legs, dim), CAR, ["t0", "lap", "sector"], {"_t": following("t0")}, hot_car)
        .withColumn("until", F.least("t1", "_t"))
        .filter("until > t0")
        .select("event", "klass", "car", "lap", "sector", "t0", "t1", "until")
    )
    asked = bounds.join(refs.select(*CAR), CAR).select(
        "event", "klass", F.col("car").alias("ref"),
        F.col("lap").alias("at_lap"), F.col("sector").alias("at_sector"), F.col("t").alias("at"),
    )
    own = (
        spans.join(refs.select(*CAR), CAR)
        .withColumnRenamed("car", "ref")
        .withColumn("bucket", _buckets("t0", "until", bucket))
    )
    placed = (
        asked.withColumn("bucket", F.expr(f"at div {bucket}"))
        .join(own, ["event", "klass", "ref", "bucket"])
        .filter("t0 <= at and at < until")
        .select(
            "event", "klass", "ref", "at", "at_lap", "at_sector", "bucket",
            _progress(F.col("at")).alias("mine"), _leg().alias("leg"),
        )
    )
    theirs = _progress(F.col("at"))
    before_me = F.struct(F.length("car"), "car") < F.struct(F.length("ref"), "ref")
    # Two legs are looked at for a question, both named by whole numbers: one's own and the next one on which
    # anyone is then. The latter comes from when each leg was in use, which does not grow with the class.
    placed = cut(placed)
    question = ["event", "klass", "ref", "at", "at_lap", "at_sector", "bucket", "mine", "leg"]
    used = legs_in_use(spans, hot_car).withColumn("bucket", _buckets("since", "until", bucket))
    later = placed.join(
        used.withColumnRenamed("leg", "other"), ["event", "klass", "bucket"]
    ).filter("other > leg and since <= at and at < until")
    onward = later.groupBy(*question).agg(F.min("other").alias("near"))
    near = placed.select(*question, F.col("leg").alias("near")).unionByName(onward)
    rivals = spans.withColumn("near", _leg()).withColumn("bucket", _buckets("t0", "until", bucket))
    ahead = (
        near.join(rivals, ["event", "klass", "near", "bucket"])
        .filter("car <> ref and t0 <= at and at < until")
        .withColumn("theirs", theirs)
        .filter((F.col("theirs") > F.col("mine")) | ((F.col("theirs") == F.col("mine")) & before_me))
        .groupBy("event", "klass", "ref", "at", "at_lap", "at_sector")
        .agg(F.max(F.struct(-F.col("theirs"), F.length("car"), "car")).alias("x"))
        .select("event", "klass", "ref", "at", "at_lap", "at_sector", F.col("x.car").alias("ahead"))
    )
    # Asked twice below, so it is written down once.
    ahead = cut(ahead)
    # Points both cars have passed, as of the later of the two, and the questions.
    pairs = ahead.select("event", "klass", "ref", "ahead").distinct()
    mine = asked.select(
        "event", "klass", "ref", F.col("at_lap").alias("lap"), F.col("at_sector").alias("sector"),
        F.col("at").alias("t_ref"),
    ).join(pairs, ["event", "klass", "ref"])
    passed = mine.join(
        bounds.select("event", "klass", F.col("car").alias("ahead"), "lap", "sector", "t"),
        ["event", "klass", "ahead", "lap", "sector"],
    ).select(
        "event", "klass", "ref", "ahead",
        F.greatest("t", "t_ref").alias("time"), F.lit(0).alias("asks"),
        F.struct(
            (F.col("lap") * 5 + F.col("sector")).alias("idx"), (F.col("t_ref") - F.col("t")).alias("gap")
        ).alias("point"),
        F.lit(None).cast("bigint").alias("at_lap"), F.lit(None).cast("bigint").alias("at_sector"),
    )
    questions = ahead.select(
        "event", "klass", "ref", "ahead", F.col("at").alias("time"), F.lit(1).alias("asks"),
        F.lit(None).cast(passed.schema["point"].dataType).alias("point"), "at_lap", "at_sector",
    )
    answered = scan(
        passed.unionByName(questions),
        ["event", "klass", "ref", "ahead"],
        ["time", "asks", "at_lap", "at_sector", "point"],
        {"_best": highest("point")},
        hot_car,
    ).filter("asks = 1")
    found = answered.select(
        "event", "klass", "ref", "at_lap", "at_sector", "ahead",
        F.greatest("_best.gap", F.lit(0).cast("bigint")).alias("_g"),
        F.col("_best.gap").alias("_raw"),
    )
    return asked.join(found, ["event", "klass", "ref", "at_lap", "at_sector"], "left").select(
        "event", "klass", F.col("ref").alias("car"), F.col("at_lap").alias("lap"),
        F.col("at_sector").alias("sector"), "at", "ahead",
        F.when(F.col("_raw").isNotNull(), F.col("_g")).alias("gap"),
    )


def _buckets(start: str, end: str, width: int) -> Column:
    """Every bucket that [start, end) touches."""
    return F.explode(F.expr(f"sequence({start} div {width}, ({end} - 1) div {width})"))


def last_and_fastest_lap(laps: DataFrame, at: int) -> DataFrame:
    """Last completed and fastest lap time of each car as of T."""
    done = laps.filter(F.col("tend") <= at)
    return done.groupBy(*CAR).agg(
        F.max("lap").alias("laps"),
        F.max_by("rt", "lap").alias("last_lap"),
        F.min(F.nullif("rt", F.lit(0))).alias("fastest_lap"),
    )


def leader_comparison(
    laps: DataFrame, legs: DataFrame, bounds: DataFrame, dim: DataFrame, refs: DataFrame, at: int,
    hot_class: bool | None = None,
) -> DataFrame:
    """The class leader (second when the selected car leads) beside the selected car."""
    places = live_position(legs, dim, at, hot_class).select("event", "klass", "car", "position")
    mine = places.join(refs.select(*CAR), CAR).select(
        "event", "klass", F.col("car").alias("selected"), F.col("position").alias("own")
    )
    against = mine.join(places.filter("position <= 2"), ["event", "klass"]).filter(
        "position = if(own = 1, 2, 1)"
    )
    rows = against.select(
        "event", "klass", "selected",
        F.explode(
            F.array(
                F.struct(F.lit("leader").alias("role"), F.col("car"), F.col("position")),
                F.struct(
                    F.lit("selected").alias("role"), F.col("selected").alias("car"),
                    F.col("own").alias("position"),
                ),
            )
        ).alias("x"),
        F.col("car").alias("rival"),
    ).select("event", "klass", "selected", "rival", "x.*")
    # Asked by car and by pair below: only the cars shown and their pairs are looked at from here on.
    rows = cut(rows)
    shown = rows.select("event", "car").distinct()
    pairs = rows.filter("role = 'selected'").select("event", "klass", "selected", "rival").distinct()
    known = bounds.filter(F.col("t") <= at).join(shown, CAR, "left_semi")
    mine = known.select(
        "event", "klass", F.col("car").alias("selected"), "lap", "sector", F.col("t").alias("t_ref")
    ).join(pairs, ["event", "klass", "selected"])
    theirs = known.select("event", "klass", F.col("car").alias("rival"), "lap", "sector", "t")
    gaps = mine.join(theirs, ["event", "klass", "rival", "lap", "sector"]).groupBy(
        "event", "klass", "selected", "rival"
    ).agg(F.max_by(F.col("t_ref") - F.col("t"), F.col("lap") * 5 + F.col("sector")).alias("gap"))
    laps = laps.join(shown, CAR, "left_semi")
    pace = last_and_fastest_lap(laps, at)
    last = (
        laps.filter(F.col("tend") <= at).groupBy(*CAR).agg(F.max_by("s", "lap").alias("s"))
    )
    rival_s = last.select("event", F.col("car").alias("rival"), F.col("s").alias("_rs"))
    full = (
        rows.join(gaps, ["event", "klass", "selected", "rival"], "left")
        .join(pace, CAR, "left")
        .join(last, CAR, "left")
        .join(rival_s, ["event", "rival"], "left")
    )
    own_row = F.col("role") == "selected"
    return full.select(
        "event", "klass", "selected", "role", "car", "position",
        F.when(own_row, F.col("gap")).alias("gap"), "fastest_lap", "last_lap",
        *[F.col("s")[i].alias(f"s{i + 1}") for i in range(5)],
        *[F.when(own_row, F.col("s")[i] - F.col("_rs")[i]).alias(f"d{i + 1}") for i in range(5)],
    )


def delay_flag(
    legs: DataFrame, dim: DataFrame, averages: DataFrame, percent: int = 50,
    ticks: int = TICKS_PER_SECOND,
) -> DataFrame:
    """Legs longer than the class's sector mean by more than so many percent."""
    tenths = averages.select(
        "event", "klass", "sector", F.round(F.col("avg_s") * 10).cast("bigint").alias("_tenths")
    ).filter("_tenths > 0")
    timed = _with_class(legs, dim).withColumn("dur", F.expr("t1 - t0"))
    return (
        timed.join(tenths, ["event", "klass", "sector"])
        .filter(F.col("dur") * 1000 > F.col("_tenths") * (ticks * (100 + percent)))
        .select("event", "klass", "car", "lap", "sector", "dur")
    )


def last_crossing(legs: DataFrame, at: int) -> DataFrame:
    """Last boundary of each car by T, and the sector it is in now."""
    done = legs.filter(F.col("t1") <= at).groupBy(*CAR).agg(
        F.max(F.struct("t1", "lap", "sector")).alias("x")
    )
    return done.select(
        *CAR, F.col("x.t1").alias("since"),
        (F.col("x.lap") + F.when(F.col("x.sector") == 5, 1).otherwise(0)).alias("lap"),
        (F.col("x.sector") % 5 + 1).alias("sector"),
    )


def _sector_values(laps: DataFrame, *keep: str) -> DataFrame:
    return (
        laps.filter(~F.col("inpit"))
        .select(*keep, F.posexplode("s").alias("_i", "v"))
        .filter("v is not null")
        .withColumn("sector", (F.col("_i") + 1).cast("bigint"))
    )


def reference_duration(
    laps: DataFrame, legs: DataFrame, archive: DataFrame, averages: DataFrame, dim: DataFrame,
    at: int, ticks: int = TICKS_PER_SECOND,
) -> DataFrame:
    """Expected time of the sector each car is in: own last lap without a stop,
    else own mean in the latest earlier event, else the class mean."""
    own = (
        _sector_values(laps.filter(F.col("tend") <= at), *CAR, "lap")
        .groupBy(*CAR, "sector")
        .agg(F.max_by("v", "lap").alias("_own"))
    )
    earlier = (
        _sector_values(archive, "car", "event_date")
        .groupBy("car", "sector", "event_date")
        .agg(F.call_function("div", F.sum("v"), F.count(F.lit(1))).alias("v"))
        .groupBy("car", "sector")
        .agg(F.max_by("v", "event_date").alias("_earlier"))
    )
    means = averages.select(
        "event", "klass", "sector",
        F.nullif((F.round(F.col("avg_s") * 10) * (ticks // 10)).cast("bigint"), F.lit(0)).alias(
            "_mean"
        ),
    )
    return (
        last_crossing(legs, at)
        .join(dim.select(*CAR, "klass"), CAR)
        .join(own, [*CAR, "sector"], "left")
        .join(earlier, ["car", "sector"], "left")
        .join(means, ["event", "klass", "sector"], "left")
        .select(
            "event", "klass", "car", "lap", "sector", "since",
            F.coalesce("_own", "_earlier", "_mean").alias("expected"),
            F.when(F.col("_own").isNotNull(), "own")
            .when(F.col("_earlier").isNotNull(), "earlier")
            .when(F.col("_mean").isNotNull(), "class")
            .otherwise("none").alias("tier"),
        )
    )


def predicted_progress(
    reference: DataFrame, at: int, percent: int = 50, parked_after: int = PARKED_TICKS
) -> DataFrame:
    """Share of the open sector done by T, never past its exit."""
    elapsed = F.lit(at) - F.col("since")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), elapsed / F.col("expected")))
    late = elapsed * 100 > F.col("expected") * (100 + percent)
    return reference.select(
        "event", "klass", "car", "lap", "sector", "tier",
        F.when(F.col("expected").isNotNull(), share).alias("share"),
        F.coalesce(late, F.lit(False)).alias("late"),
        F.when(elapsed > parked_after, "parked")
        .when(F.col("expected").isNull(), "frozen")
        .otherwise("moving").alias("state"),
    )


def visible_as_of(rows: DataFrame, at: int, time: str = "tod") -> DataFrame:
    """Rows without a time, or with one not after T."""
    return rows.filter(F.col(time).isNull() | (F.col(time) <= at))


def frozen_sector_marks(
    legs: DataFrame, dim: DataFrame, at: int | None = None,
    hot_car: bool | None = None, hot_class: bool | None = None,
) -> DataFrame:
    """Each crossing against the bests up to its own moment, never judged again."""
    seen = legs if at is None else legs.filter(F.col("t1") <= at)
    timed = _with_class(seen, dim).withColumn("dur", F.expr("t1 - t0"))
    own = scan(
        timed, [*CAR, "sector"], ["t1", "lap"], {"_own": lowest("dur", before=True)}, hot_car
    )
    both = scan(
        own, ["event", "klass", "sector"], ["t1", "car", "lap"],
        {"_class": lowest("dur", before=True)}, hot_class,
    )

    def beats(best):
        return F.col(best).isNull() | (F.col("dur") < F.col(best))

    return both.select(
        "event", "klass", "car", "lap", "sector", "dur",
        F.when(beats("_class"), "class best").when(beats("_own"), "own best").otherwise("none")
        .alias("mark"),
    )


def slow_zones(
    legs: DataFrame, stops: DataFrame, at: int, window: int, limit: int, votes: int = 1
) -> DataFrame:
    """Sectors with recent speed readings under the limit; in-laps are skipped."""
    recent = legs.filter((F.col("t1") <= at) & (F.col("t1") > at - window)).filter(
        "speed is not null"
    )
    green = recent.join(stops.select("event", "car", "lap"), ["event", "car", "lap"], "left_anti")
    return green.groupBy("event", "sector").agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_if(F.col("speed") < limit).alias("slow"),
        (F.count_if(F.col("speed") < limit) >= votes).alias("zone"),
    )


def feed_state(rows: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """Per day, what ails the feed at `now` (ms), a column of the day's figures.

    rows: event_date, received (ms), lap_end (ms of day); status: event_date, live.
    """
    per_day = rows.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("received").alias("written"),
        F.max("lap_end").alias("newest"),
    )
    day_start = F.unix_date(F.col("event_date").cast("date")).cast("bigint") * 86_400_000
    return (
        status.select("event_date", "live")
        .join(per_day, "event_date", "left")
        .withColumn("now", now)
        .select(
            "event_date",
            (F.col("now") - day_start - F.col("newest")).alias("lag"),
            F.when(~F.col("live") | F.col("rows").isNull(), "OFFLINE")
            .when(F.col("now") - F.col("written") > SILENT_MS, "SCRAPER SILENT")
            .when(F.col("now") - day_start - F.col("newest") > STALE_MS, "SOURCE STALE")
            .otherwise("STREAMING").alias("state"),
        )
    )


def data_advance_age(rows: DataFrame, now: Column) -> DataFrame:
    """Time since the day's newest data time last changed.

    The newest data time only ever rises to its maximum, so its last change is
    the first row showing that maximum: an aggregate, no running window.
    """
    per_day = rows.groupBy("event_date").agg(
        F.min(F.struct((-F.col("lap_end")).alias("neg"), "received")).alias("x"),
        F.count(F.lit(1)).alias("rows"),
        F.max("received").alias("written"),
    )
    aged = per_day.withColumn("age", now - F.col("x.received"))
    return aged.select(
        "event_date", "age",
        F.when(F.col("age") > STOPPED_MS, "stopped").when(F.col("age") > STALE_MS, "stale")
        .otherwise("fresh").alias("level"),
    )


def clock_frontier(
    rows: DataFrame, shown: Column, buffer_ms: int = 8_000, max_lag_ms: int = 30_000
) -> DataFrame:
    """Display clock per day: kept while near the newest lap end, else re-anchored.

    `shown` is the clock on display, a column over `newest` and `rows`.
    """
    newest = rows.groupBy("event_date").agg(
        F.max("lap_end").alias("newest"), F.count(F.lit(1)).alias("rows")
    )
    held = newest.withColumn("_shown", shown)
    behind = F.col("newest") - F.col("_shown") > max_lag_ms
    return held.select(
        "event_date", "newest",
        F.when(F.col("_shown").isNull() | behind, F.col("newest") - buffer_ms)
        .otherwise(F.col("_shown")).alias("clock"),
        F.coalesce(behind, F.lit(True)).alias("reanchored"),
    )
