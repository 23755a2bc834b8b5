"""Distance, component wear, part life, and use of the application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexline.functions.ordered import latest, number, previous, rank, scan, total

# Sector lengths in metres; components with their service interval in km.
SECTOR_METRES = (3300, 3300, 6000, 9400, 2400)
COMPONENTS = {
    "engine": 50000, "oil": 5000, "disc": 3000, "pad": 1500, "shaft": 10000, "bearing": 5000,
    "turbo": 8000, "diff": 20000,
}
WARN_SHARE = 0.85
NEWEST_VISITS = 2000
SMALLEST_SHARE = 2
# Browser tokens and operating systems by ordered pattern.
BROWSER = r"(Edg|OPR|Chrome|Firefox|Safari)/[\d.]+"
SYSTEMS = (
    ("Mac OS X", "macOS"), ("Windows", "Windows"), ("Android", "Android"),
    ("iPhone|iPad|iOS", "iOS"), ("Linux", "Linux"),
)


def millimetres_at(progress: Column, metres: tuple[int, ...] = SECTOR_METRES) -> Column:
    """Distance for a progress of five per lap, in whole millimetres."""
    lap = F.floor(progress / 5)
    within = progress - lap * 5
    sector = F.greatest(F.lit(0), F.least(F.lit(4), F.floor(within)))
    before = [sum(metres[:i]) for i in range(5)]
    at = (sector + 1).cast("int")
    start = F.element_at(F.array(*[F.lit(m) for m in before]), at)
    length = F.element_at(F.array(*[F.lit(m) for m in metres]), at)
    part = F.round((within - sector) * length * 1000).cast("bigint")
    return lap * (sum(metres) * 1000) + start.cast("bigint") * 1000 + part


def driven_km(
    samples: DataFrame, metres: tuple[int, ...] = SECTOR_METRES, hot_car: bool | None = None
) -> DataFrame:
    """Sum of forward steps between neighbouring samples of a car.

    A sample without progress, or behind the one before, only starts anew.
    samples: event, car, at, id, progress.
    """
    steps = scan(samples, ["event", "car"], ["at", "id"], {"_p": previous("progress")}, hot_car)
    step = millimetres_at(F.col("progress"), metres) - millimetres_at(F.col("_p"), metres)
    forward = F.when(F.col("progress") > F.col("_p"), F.greatest(step, F.lit(0).cast("bigint")))
    return steps.groupBy("event", "car").agg(
        (F.coalesce(F.sum(forward), F.lit(0)) / 1_000_000).alias("km")
    )


def component_wear(state: DataFrame) -> DataFrame:
    """Wear of all components of each car, in service order; zero means on condition.

    state: car, component, interval (nullable), actual (km).
    """
    defaults = F.array(
        *[
            F.struct(F.lit(c).alias("component"), F.lit(i).cast("bigint").alias("standard"),
                     F.lit(n).alias("at"))
            for n, (c, i) in enumerate(COMPONENTS.items())
        ]
    )
    every = state.select("car").distinct().select("car", F.explode(defaults).alias("d")).select(
        "car", "d.*"
    )
    worn = every.join(state, ["car", "component"], "left").select(
        "car", "component", "at",
        F.coalesce("interval", "standard").alias("interval"),
        F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce(F.nullif("interval", F.lit(0)), "standard").alias("_service"),
    )
    limited = F.col("interval") > 0
    share = F.when(limited, F.col("actual") / F.col("interval"))
    by_service = Window.partitionBy("car").orderBy(~limited, "interval", "at")
    return worn.select(
        "car", "component", "interval", "actual",
        F.when(limited, F.col("interval") - F.col("actual")).alias("left"),
        share.alias("share"),
        F.when(~limited, "on condition").when(share >= 1, "due").when(share >= WARN_SHARE, "warn")
        .otherwise("ok").alias("state"),
        F.row_number().over(by_service).alias("place"),
    )


def part_life(swaps: DataFrame, hot: bool | None = None) -> DataFrame:
    """Kilometres of each retired part: odometer out minus in.

    In is the part before's out. Without a reading, out is in plus the estimate,
    so between readings the estimates add up: with A their running sum, out is
    A plus the last reading less A there. swaps: car, component, id, odometer
    (nullable), actual.
    """
    key, order = ["car", "component"], ["id"]
    blank = F.when(F.col("odometer").isNull(), F.col("actual")).otherwise(F.lit(0).cast("bigint"))
    summed = scan(swaps.withColumn("_blank", blank), key, order, {"_a": total("_blank")}, hot)
    based = scan(
        summed.withColumn("_base", F.col("odometer") - F.col("_a")), key, order,
        {"_from": latest("_base")}, hot,
    ).withColumn("odo_out", F.coalesce("_from", F.lit(0)) + F.col("_a"))
    ends = scan(based, key, order, {"_in": previous("odo_out"), "part_no": number()}, hot)
    odo_in = F.coalesce("_in", F.lit(0))
    return ends.select(
        "car", "component", "id", "part_no", odo_in.alias("odo_in"), "odo_out",
        (F.col("odo_out") - odo_in).alias("km"),
    )


def part_archive(life: DataFrame, fitted: DataFrame) -> DataFrame:
    """Grid per car: a row per part number, a column per component; the last
    cell of a column is the part in use.

    fitted: car, component, odo, actual.
    """
    retired = life.select(
        "car", "component", "part_no",
        F.concat_ws(" ", "odo_in", F.lit("-"), "odo_out", F.lit(":"), "km").alias("cell"),
    )
    counts = life.groupBy("car", "component").agg(F.max("part_no").alias("_n"))
    current = fitted.join(counts, ["car", "component"], "left").select(
        "car", "component", (F.coalesce("_n", F.lit(0)) + 1).alias("part_no"),
        F.concat_ws(" ", "odo", F.lit("- IN USE ~"), F.col("odo") + F.col("actual"), F.lit(": ~"),
                    "actual").alias("cell"),
    )
    cells = retired.unionByName(current)
    return cells.groupBy("car", "part_no").pivot("component", list(COMPONENTS)).agg(F.max("cell"))


def usage_ranking(usage: DataFrame) -> DataFrame:
    """Seconds per panel with rank and share of the top one, and its sessions.

    usage: session, panel, date, at, seconds; the last report of a (session,
    panel, date) replaces earlier ones.
    """
    merged = usage.groupBy("session", "panel", "date").agg(
        F.max(F.struct("at", "seconds"))["seconds"].alias("seconds")
    )
    panels = merged.groupBy("panel").agg(
        F.sum("seconds").alias("seconds"), F.count_distinct("session").alias("sessions")
    )
    ranked = scan(
        panels.withColumn("_less", -F.col("seconds")), [], ["_less", "panel"],
        {"rank": rank("_less")},
    )
    top = panels.agg(F.greatest(F.max("seconds"), F.lit(1))).scalar()
    share = F.call_function("div", F.col("seconds") * 200 + top, top * 2)
    return ranked.select(
        "panel", "seconds", "rank", F.greatest(F.lit(SMALLEST_SHARE), share).alias("share"),
        "sessions",
    )


def short_agent(agent: Column) -> Column:
    """Browser and system of an agent string, else its first forty characters."""
    names = F.regexp_extract_all(agent, F.lit(BROWSER), F.lit(1))
    last = F.element_at(names, -1)
    browser = F.when(
        F.size(names) > 0,
        F.when(last == "Edg", "Edge").when(last == "OPR", "Opera").otherwise(last),
    )
    system = F.coalesce(*[F.when(agent.rlike(p), name) for p, name in SYSTEMS])
    named = F.nullif(F.concat_ws(" · ", browser, system), F.lit(""))
    return F.coalesce(named, F.substring(agent, 1, 40))


def visitor_log(visits: DataFrame, newest: int = NEWEST_VISITS) -> DataFrame:
    """Per address of the newest visits: count, first and last, and the agent of
    the oldest visit that has one.

    visits: id, ip, ua, ts.
    """
    recent = visits.orderBy(F.desc("ts"), F.desc("id")).limit(newest)
    address = F.coalesce(F.nullif("ip", F.lit("")), F.lit("(unknown)"))
    known = F.when(F.nullif(F.col("ua"), F.lit("")).isNotNull(), F.struct("ts", "id"))
    by = recent.groupBy(address.alias("ip")).agg(
        F.count(F.lit(1)).alias("visits"), F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"), F.min_by("ua", known).alias("ua"),
    )
    return by.withColumn("browser", F.when(F.col("ua").isNotNull(), short_agent(F.col("ua"))))


def unread_count(messages: DataFrame, columns: DataFrame) -> DataFrame:
    """Unread messages per column: above its cursor and not its owner's own.

    messages: id, channel, sender; columns: name, channels (own and peer's),
    owner, cursor.
    """
    opened = columns.select("name", "owner", "cursor", F.explode("channels").alias("channel"))
    counted = (
        messages.join(opened, "channel")
        .filter((F.col("id") > F.coalesce("cursor", F.lit(0))) & (F.col("sender") != F.col("owner")))
        .groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    )
    return columns.select("name").join(counted, "name", "left").select(
        "name", F.coalesce("n", F.lit(0)).alias("unread")
    )


def fastest_flag(laps: DataFrame, dim: DataFrame) -> DataFrame:
    """Fastest laps per car and per class, from the times themselves."""
    timed = laps.filter("rt > 0").select("event", "car", "lap", "rt").join(
        dim.select("event", "car", "klass"), ["event", "car"]
    )
    per_car = timed.groupBy("event", "klass", "car").agg(F.min("rt").alias("_car"))
    per_class = per_car.groupBy("event", "klass").agg(F.min("_car").alias("_class"))
    best = per_car.join(per_class, ["event", "klass"]).select("event", "car", "_car", "_class")
    return timed.join(best, ["event", "car"]).select(
        "event", "klass", "car", "lap", "rt",
        (F.col("rt") == F.col("_car")).alias("fastest_of_car"),
        (F.col("rt") == F.col("_class")).alias("fastest_of_class"),
    )
