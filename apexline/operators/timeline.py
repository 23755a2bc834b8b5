"""Timeline derivation: raw laps to legs, boundaries and class positions.

A raw lap has event, car, klass, lap, s (five sector times), spd (five sector
speeds), tend, rt, inpit, driver, vehicle. Times are bigint ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apexline.functions.ordered import following, has_hot_group, number, rank, scan

TICKS_PER_SECOND = 1_000_000
# Fixed value: the palette has sixteen colours.
PALETTE_SIZE = 16


def legs(laps: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sector legs of each lap; a missing sector neither emits nor advances.

    `keep` names lap columns to carry along.
    """
    zero = F.lit(0).cast("bigint")

    def reached(upto):
        return F.aggregate(
            F.slice("s", 1, upto), zero, lambda acc, x: acc + F.coalesce(x, zero)
        )

    timed = laps.select(
        "event", "car", "lap", *keep,
        F.col("tend").alias("_end"),
        F.coalesce(F.nullif(F.col("rt"), zero), reached(F.lit(5))).alias("_rt"),
        F.arrays_zip(
            F.col("s").alias("s"),
            F.col("spd").alias("spd"),
            F.transform("s", lambda x, i: reached(i + 1)).alias("upto"),
        ).alias("z"),
    )
    out = timed.select(
        "event", "car", "lap", *keep, "_end", "_rt", F.posexplode("z").alias("i", "z")
    )
    start = F.col("_end") - F.col("_rt") + F.col("z.upto")
    return out.filter("z.s is not null").select(
        "event", "car", "lap",
        (F.col("i") + 1).cast("bigint").alias("sector"),
        (start - F.col("z.s")).alias("t0"),
        start.alias("t1"),
        F.col("z.spd").alias("speed"),
        *keep,
    )


def car_dim(laps: DataFrame) -> DataFrame:
    """Class and vehicle of a car are those of its highest lap."""
    return laps.groupBy("event", "car").agg(
        F.max_by("klass", "lap").alias("klass"), F.max_by("vehicle", "lap").alias("vehicle")
    )


def classed(laps: DataFrame, hot_car: bool | None = None) -> DataFrame:
    """Laps with the car's class in place of the lap's.

    As a window it shares the shuffle by car with what follows; a car too long
    for one task gets its class by a join instead.
    """
    if hot_car is None:
        hot_car = has_hot_group(laps, ["event", "car"])
    if hot_car:
        return laps.drop("klass").join(car_dim(laps).select("event", "car", "klass"), ["event", "car"])
    return laps.withColumn(
        "klass", F.max_by("klass", "lap").over(Window.partitionBy("event", "car"))
    )


def boundaries(laps: DataFrame, hot_car: bool | None = None) -> DataFrame:
    """Leg ends numbered along each car, with the car's class."""
    if hot_car is None:
        hot_car = has_hot_group(laps, ["event", "car"])
    ends = legs(classed(laps, hot_car), keep=("klass",)).select(
        "event", "klass", "car", "lap", "sector", F.col("t1").alias("t")
    )
    return scan(
        ends,
        ["event", "car"],
        ["t", "lap", "sector"],
        {"k": number(), "t_next": following("t")},
        hot_car,
    )


def class_position(bounds: DataFrame, hot_class: bool | None = None) -> DataFrame:
    """Position at each boundary among the cars of the class.

    A rival is ahead when it reached its k-th boundary earlier, or at the same
    instant and its next one too (a leg of zero length).
    """
    group = ["event", "klass", "k"]
    if hot_class is None:
        hot_class = has_hot_group(bounds, group)
    ranked = scan(bounds, group, ["t", "car"], {"_rank": rank("t")}, hot_class)
    stuck = F.coalesce((F.col("t_next") == F.col("t")).cast("bigint"), F.lit(0))
    if hot_class:
        counted = (
            bounds.filter("t_next = t").groupBy(*group, "t").agg(F.count(F.lit(1)).alias("_stuck"))
        )
        ranked = ranked.join(counted, [*group, "t"], "left")
        tied = F.coalesce(F.col("_stuck"), F.lit(0))
    else:
        tied = F.sum(stuck).over(Window.partitionBy(*group, "t"))
    return ranked.withColumn("position", F.col("_rank") + tied - stuck).select(
        "event", "klass", "car", "k", "lap", "sector", "t", "position"
    )


def progress_chart(positions: DataFrame) -> DataFrame:
    """Laps done at each boundary, with position and time."""
    return positions.select(
        "event", "klass", "car", "k", "lap", "sector",
        F.round(((F.col("lap") - 1) * 5 + F.col("sector")) / 5, 4).alias("progress"),
        "position", "t",
    )


def lap_positions(positions: DataFrame) -> DataFrame:
    """Position at the end of each lap."""
    return positions.filter("sector = 5").select("event", "klass", "car", "lap", "position")


def sector_times(laps: DataFrame) -> DataFrame:
    """Sector times of each lap, gaps kept."""
    return laps.select("event", "car", "lap", *[F.col("s")[i].alias(f"s{i + 1}") for i in range(5)])


def pit_laps(laps: DataFrame, hot_car: bool | None = None) -> DataFrame:
    """Flagged laps of each car, numbered, with the car's stop count."""
    flagged = laps.filter("inpit").select("event", "car", "lap")
    counts = flagged.groupBy("event", "car").agg(F.count(F.lit(1)).alias("stops"))
    return scan(flagged, ["event", "car"], ["lap"], {"stop": number()}, hot_car).join(
        counts, ["event", "car"]
    )


def pit_windows(laps: DataFrame) -> DataFrame:
    """Pit entry, duration and exit of each in-lap that has either reading."""
    return laps.filter("inpit and (pit_in is not null or pit_dur is not null)").select(
        "event", "car", "lap", "pit_in", "pit_dur",
        (F.col("pit_in") + F.col("pit_dur")).alias("pit_out"),
    )


def driver_by_lap(laps: DataFrame) -> DataFrame:
    """Driver of each lap, and the car's display name: its first lap's driver."""
    names = laps.groupBy("event", "car").agg(F.min_by("driver", "lap").alias("name"))
    return laps.select("event", "car", "lap", "driver").join(names, ["event", "car"])


def class_members(dim: DataFrame, hot_class: bool | None = None) -> DataFrame:
    """Cars of each class in start-number order, with their palette slot."""
    placed = scan(
        dim.select("event", "klass", "car", F.length("car").alias("_len")),
        ["event", "klass"],
        ["_len", "car"],
        {"place": number()},
        hot_class,
    )
    return placed.select(
        "event", "klass", "car", "place",
        ((F.col("place") - 1) % PALETTE_SIZE).alias("slot"),
    )


def class_max_lap(laps: DataFrame) -> DataFrame:
    """Highest lap in each class, at least one."""
    per_car = laps.groupBy("event", "car").agg(
        F.max("lap").alias("lap"), F.max_by("klass", "lap").alias("klass")
    )
    return per_car.groupBy("event", "klass").agg(
        F.greatest(F.max("lap"), F.lit(1)).alias("max_lap")
    )


def tenths_of_mean(summed, count, ticks: int):
    """Mean in seconds to one decimal, half up, in whole-number arithmetic."""
    top = summed.cast("decimal(38,0)") * 20 + count * ticks
    # floor of a non-negative quotient
    return F.call_function("div", top.cast("decimal(38,0)"), count * (2 * ticks)) / 10


def _sector_means(rows: DataFrame, dim: DataFrame, kept, ticks: int) -> DataFrame:
    """Sum per car first, so that a large class is already reduced when it meets."""
    values = rows.filter(kept).select("event", "car", F.posexplode("s").alias("i", "v"))
    per_car = (
        values.filter("v is not null")
        .groupBy("event", "car", "i")
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.count(F.lit(1)).alias("n"))
    )
    slots = dim.select("event", "klass").distinct().withColumn(
        "i", F.explode(F.array(*[F.lit(i) for i in range(5)]))
    )
    sums = (
        per_car.join(dim.select("event", "car", "klass"), ["event", "car"])
        .groupBy("event", "klass", "i")
        .agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    )
    return slots.join(sums, ["event", "klass", "i"], "left").select(
        "event", "klass",
        (F.col("i") + 1).cast("bigint").alias("sector"),
        F.coalesce(
            F.when(F.col("n") > 0, tenths_of_mean(F.col("v"), F.col("n"), ticks)), F.lit(0.0)
        ).alias("avg_s"),
    )


def class_sector_avg(laps: DataFrame, ticks: int = TICKS_PER_SECOND) -> DataFrame:
    """Mean sector time per class over laps not flagged in, present values only."""
    return _sector_means(laps, car_dim(laps), ~F.col("inpit"), ticks)


def class_sector_avg_green(laps: DataFrame, ticks: int = TICKS_PER_SECOND) -> DataFrame:
    """As class_sector_avg, over laps of pit status N: no in- and no out-laps."""
    return _sector_means(laps, car_dim(laps), F.col("pit_status") == "N", ticks)


def pit_status(laps: DataFrame) -> DataFrame:
    """J for an in-lap, A for the lap after one, N else."""
    out_laps = laps.filter("inpit").select(
        "event", "car", (F.col("lap") + 1).alias("lap"), F.lit(True).alias("_out")
    )
    return laps.join(out_laps, ["event", "car", "lap"], "left").withColumn(
        "pit_status",
        F.when(F.col("inpit"), "J").when(F.col("_out"), "A").otherwise("N"),
    ).drop("_out")


def all_classes(dim: DataFrame, max_laps: DataFrame, averages: DataFrame) -> DataFrame:
    """The whole field of an event as one class."""
    cars = dim.groupBy("event").agg(F.count(F.lit(1)).alias("cars"))
    laps = max_laps.groupBy("event").agg(F.max("max_lap").alias("max_lap"))
    means = averages.groupBy("event").agg(
        *[
            F.round(F.avg(F.when(F.col("sector") == i, F.col("avg_s"))), 4).alias(f"avg_s{i}")
            for i in range(1, 6)
        ]
    )
    return cars.join(laps, "event").join(means, "event")


def dataset_report(laps: DataFrame, published: str = "s", ticks: int = TICKS_PER_SECOND) -> DataFrame:
    """Per class: cars, laps and means, largest class first; with event totals.

    The time range is that of the laps' sectors `s`; means are over the sectors of the column `published`, which
    holds the times before any repair. One pass: laps are summed per car, cars per class, classes per event.
    """
    zero = F.lit(0).cast("bigint")
    reached = [F.lit(0).cast("bigint")]
    for i in range(5):
        reached.append(reached[-1] + F.coalesce(F.col("s")[i], zero))
    begin = F.col("tend") - F.coalesce(F.nullif(F.col("rt"), zero), reached[5])
    there = [F.col("s")[i].isNotNull() for i in range(5)]
    counted = [F.when(~F.col("inpit"), F.col(published)[i]) for i in range(5)]
    full = F.col("pit_in").isNotNull() & F.col("pit_dur").isNotNull()
    each = range(1, 6)
    cars = laps.groupBy("event", "car").agg(
        F.max_by("klass", "lap").alias("klass"),
        F.max("lap").alias("lap"),
        *[F.sum(v.cast("decimal(38,0)")).alias(f"v{i}") for i, v in zip(each, counted)],
        *[F.count(v).alias(f"n{i}") for i, v in zip(each, counted)],
        F.min(F.least(*[F.when(there[i], begin + reached[i]) for i in range(5)])).alias("t_min"),
        F.max(F.greatest(*[F.when(there[i], begin + reached[i + 1]) for i in range(5)])).alias("t_max"),
        F.count_if("inpit").alias("stops"),
        F.count_if(F.col("inpit") & full).alias("full_windows"),
    )
    classes = cars.groupBy("event", "klass").agg(
        F.count(F.lit(1)).alias("cars"),
        F.greatest(F.max("lap"), F.lit(1)).alias("max_lap"),
        *[F.sum(f"{c}{i}").alias(f"{c}{i}") for c in "vn" for i in each],
        F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"),
        F.sum("stops").alias("stops"), F.sum("full_windows").alias("full_windows"),
    )
    # A row per class: the window is over few.
    event = Window.partitionBy("event")
    ranges = {name: fn(name).over(event) for name, fn in (("t_min", F.min), ("t_max", F.max))}
    totals = {name: F.sum(name).over(event) for name in ("stops", "full_windows")}
    mean = lambda i: F.when(F.col(f"n{i}") > 0, tenths_of_mean(F.col(f"v{i}"), F.col(f"n{i}"), ticks))
    return (
        classes.withColumns(ranges | totals)
        .filter("t_min is not null")
        .select(
            "event", "klass", "cars", "max_lap",
            *[F.coalesce(mean(i), F.lit(0.0)).alias(f"avg_s{i}") for i in each],
            "t_min", "t_max", "stops", "full_windows",
        )
        .withColumn("missing_exit", F.col("stops") - F.col("full_windows"))
        .orderBy("event", F.desc("cars"), "klass")
    )
