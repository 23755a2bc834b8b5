"""Race tables derived from the given tables, for queries and tests.

Every table is a deterministic plan over whole given tables, so its size grows
with theirs. Times are bigint microseconds, speeds bigint hundredths.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apexline.functions.ordered import has_hot_group, number, previous, scan, total
from apexline.sources.tables import table

HOUR = 3_600_000_000
DAY = 24 * HOUR


def day_text(t):
    return F.date_from_unix_date(F.call_function("div", t, F.lit(DAY)).cast("int")).cast("string")


class Timing:
    """Timing tables read from `events`: a user is a car, an event a crossing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.events = table(spark, folder, "events").select(
            F.concat(F.lit("E"), F.col("user_id") % 2).alias("event"),
            F.col("user_id").cast("string").alias("car"),
            F.concat(F.lit("C"), F.col("user_id") % 6).alias("klass"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
            "event_id",
            "event_type",
            F.round(F.col("value") * 100).cast("bigint").alias("cents"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )

    @cached_property
    def hot_car(self) -> bool:
        """Is one car's history too long for one task? One narrow scan decides."""
        return has_hot_group(self.events, ["car"])

    @cached_property
    def hot_class(self) -> bool:
        """Does a class hold too many cars for one task?"""
        return has_hot_group(self.events.select("event", "klass", "car").distinct(), ["klass"])

    @cached_property
    def crossing(self) -> DataFrame:
        """One row per crossing; the first event of a car is its start."""
        numbered = scan(
            self.events.withColumns(
                {
                    "buys": F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("bigint")
                }
            ),
            ["event", "car"],
            ["t", "event_id"],
            {
                "n": number(),
                "t_before": previous("t"),
                "bought": total("buys"),
            },
            self.hot_car,
        )
        return numbered.filter("n > 1").select(
            "event", "car", "klass", "event_id", "t", "event_type", "cents", "k",
            F.expr("(n - 2) div 5 + 1").alias("lap"),
            ((F.col("n") - 2) % 5 + 1).alias("sector"),
            (F.col("t") - F.col("t_before")).alias("dur"),
            F.when(F.col("k") % 13 != 0, F.col("t") - F.col("t_before")).alias("reading"),
            F.when(F.col("k") % 11 != 0, F.col("bought")).alias("counter"),
        )

    @cached_property
    def lap(self) -> DataFrame:
        """Raw lap rows; a lap still being driven has fewer crossings and no lap time."""

        def at(sector, col):
            return F.max(F.when(F.col("sector") == sector, F.col(col)))

        laps = (
            self.crossing.groupBy("event", "car", "klass", "lap")
            .agg(
                F.array(*[at(i, "reading") for i in range(1, 6)]).alias("s"),
                F.array(*[at(i, "cents") for i in range(1, 6)]).alias("spd"),
                F.max("t").alias("tend"),
                F.when(F.count(F.lit(1)) == 5, F.sum("dur")).alias("rt"),
                (F.count_if(F.col("event_type") == "error") >= 2).alias("inpit"),
                at(1, "event_type").alias("driver"),
                F.max_by("event_type", "sector").alias("vehicle"),
                at(5, "dur").alias("d5"),
                at(2, "dur").alias("d2"),
                at(4, "k").alias("k4"),
                F.max_by("k", "sector").alias("k5"),
            )
        )
        return laps.select(
            "event", "car", "klass", "lap", "s", "spd", "tend", "rt", "inpit", "driver", "vehicle",
            F.expr("if(inpit and k5 % 7 <> 0, tend - d5 div 10, null)").alias("pit_in"),
            F.expr("if(inpit and k4 % 5 <> 0, d2, null)").alias("pit_dur"),
            "k5",
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        """Growing versions of each lap row as a feed sends them, some twice."""

        def upto(i):
            return F.max(F.when(F.col("b.sector") == i, F.col("b.reading")))

        a, b = self.crossing.alias("a"), self.crossing.alias("b")
        grown = (
            a.join(
                b,
                F.expr(
                    "a.event = b.event and a.car = b.car and a.lap = b.lap"
                    " and b.sector <= a.sector"
                ),
            )
            .groupBy("a.event", "a.car", "a.lap", "a.sector", "a.t", "a.k", "a.counter", "a.klass")
            .agg(
                *[upto(i).alias(f"s{i}") for i in range(1, 6)],
                F.sum("b.dur").alias("run"),
                (F.count_if(F.col("b.event_type") == "error") >= 2).alias("inpit"),
            )
            .withColumn("lap_time", F.when(F.col("sector") == 5, F.col("run")))
        )
        return grown.withColumn(
            "again", F.explode(F.expr("if(k % 3 = 0, array(0, 1), array(0))"))
        ).select(
            "event", "car", "klass", "lap", "s1", "s2", "s3", "s4", "s5", "lap_time",
            F.col("t").alias("tend"), "inpit", "counter",
            (F.col("t") + F.col("again")).alias("received"),
        )

    @cached_property
    def feed_lap(self) -> DataFrame:
        """Lap rows as the feed shows them: the lap time is the lap before's."""
        before = self.lap.select(
            "event", "car", (F.col("lap") + 1).alias("lap"), F.col("rt").alias("rt_before")
        )
        late = self.lap.join(before, ["event", "car", "lap"], "left")
        return late.select(
            "event", "car", "klass", "lap",
            F.when(
                F.col("k5") % 2 == 0,
                F.transform("s", lambda x, i: F.when(i < 4, x)),
            ).otherwise(F.col("s")).alias("s"),
            "spd", "tend", F.col("rt_before").alias("rt"), "inpit", "driver", "vehicle",
        )


def seconds_text(ms):
    """'83.400' from 83400."""
    return F.concat(
        F.call_function("div", ms, F.lit(1000)).cast("string"),
        F.lit("."),
        F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def minutes_text(ms):
    """'1:23.400' from 83400."""
    minutes = F.call_function("div", ms, F.lit(60_000))
    return F.concat(
        minutes.cast("string"), F.lit(":"),
        F.lpad(F.call_function("div", ms % 60_000, F.lit(1000)).cast("string"), 2, "0"),
        F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"),
    )


def clock_text(ms):
    """'13:05:09.250' for an instant in ms."""
    return F.concat(hms_text(ms), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def hms_text(ms):
    """'13:05:09' for an instant in ms."""
    s = F.call_function("div", ms % 86_400_000, F.lit(1000))

    def two(x):
        return F.lpad(x.cast("string"), 2, "0")

    return F.concat_ws(
        ":",
        two(F.call_function("div", s, F.lit(3600))),
        two(F.call_function("div", s % 3600, F.lit(60))),
        two(s % 60),
    )


class Frames:
    """Feed frames of at most twenty crossings each, as JSON text."""

    def __init__(self, timing: Timing):
        self.timing = timing

    @cached_property
    def rows(self) -> DataFrame:
        return self.timing.crossing.withColumns(
            {
                "frame_no": F.expr("event_id div 20"),
                "ms": F.expr("reading div 1000"),
                "t_ms": F.expr("t div 1000"),
            }
        )

    @cached_property
    def once(self) -> DataFrame:
        k, ms = F.col("k"), F.col("ms")
        shown = (
            F.when(ms.isNull(), F.when(k % 2 == 0, "-").otherwise(""))
            .when(k % 5 == 0, minutes_text(ms))
            .otherwise(seconds_text(ms))
        )
        car = F.struct(
            F.when(k % 97 == 0, " ").otherwise(F.col("car")).alias("STNR"),
            F.col("klass").alias("CLASSNAME"),
            F.col("event_type").alias("NAME"),
            F.concat(F.lit("V"), k % 3).alias("CAR"),
            F.when(k % 89 == 0, "x").when(k % 6 != 0, F.col("lap").cast("string")).alias("LAPS"),
            F.col("lap").alias("LAP"),
            *[F.when(F.col("sector") == i, shown).alias(f"S{i}TIME") for i in range(1, 6)],
            *[
                F.when(F.col("sector") == i, F.col("cents") / 100).alias(f"S{i}SPEED")
                for i in range(1, 6)
            ],
            F.when(F.col("sector") == 5, shown).alias("LASTLAPTIME"),
            F.when(k % 4 == 0, clock_text(F.col("t_ms"))).alias("TAGESZEIT"),
            F.when(k % 4 == 1, F.col("t_ms")).alias("LASTPASSING"),
            F.col("counter").alias("PITSTOPCOUNT"),
        )
        note = F.struct(
            F.when(k % 17 == 0, "--").otherwise(hms_text(F.col("t_ms"))).alias("MESSAGETIME"),
            F.when(k % 19 == 0, "  ")
            .otherwise(F.concat(F.lit(" # "), "car", F.lit(" "), "event_type"))
            .alias("MESSAGE"),
        )
        n = F.col("frame_no")
        frames = (
            self.rows.groupBy("event", "frame_no")
            .agg(
                (F.expr("max(t) div 1000") + 500).alias("received"),
                F.array_sort(F.collect_list(F.struct("event_id", car.alias("c")))).alias("cs"),
                F.array_sort(F.collect_list(F.struct("event_id", note.alias("m")))).alias("ms"),
            )
            .withColumns(
                {
                    "pid": F.when(n % 7 == 0, "LTS_TIMESYNC").when(n % 7 == 3, "3")
                    .when(n % 7 == 5, "4").otherwise("0"),
                    "event_date": day_text(F.col("received") * 1000),
                }
            )
        )
        board = ~F.col("pid").isin("LTS_TIMESYNC", "3")
        body = F.struct(
            F.col("pid").alias("PID"),
            F.concat("event", F.lit("-"), n % 5).alias("EXPORTID"),
            F.concat(F.lit("S"), n % 3).alias("SESSION"),
            F.concat(F.lit("H"), n % 2).alias("HEAT"),
            F.element_at(
                F.array(
                    *[
                        F.lit(x)
                        for x in (
                            "Nürburgring", "24h Nordschleife", "Hockenheimring", "", "NUERBURGRING",
                        )
                    ]
                ),
                (n % 5 + 1).cast("int"),
            ).alias("TRACKNAME"),
            F.when(n % 10 == 3, F.date_format(F.timestamp_millis("received"),
                                              "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
            .when(n % 10 != 9, clock_text(F.col("received"))).alias("TOD"),
            F.when(n % 3 == 0, 3).otherwise(5).alias("NROFINTERMEDIATETIMES"),
            F.when(board, F.col("cs.c")).alias("RESULT"),
            F.when(F.col("pid") == "3", F.col("ms.m")).alias("MESSAGES"),
        )
        return frames.select(
            "event_date", "pid", "frame_no", "event", "received",
            F.to_json(body).alias("payload"),
        )

    @cached_property
    def log(self) -> DataFrame:
        """Frames as received: every fourth is sent again a second later."""
        times = F.expr("if(frame_no % 4 = 0, array(0, 1000), array(0))")
        return self.once.withColumn("later", F.explode(times)).select(
            day_text((F.col("received") + F.col("later")) * 1000).alias("event_date"),
            "pid", "frame_no", "event",
            (F.col("received") + F.col("later")).alias("received"),
            "payload",
        )
