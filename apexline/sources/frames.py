"""Feed frames: JSON text to raw lap rows, messages and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.texts import stripped
from apexline.functions.times import berlin_instant, clock_ms, instant_clock_ms

# The feed's heartbeat channels and its per-car crossing-time keys.
HEARTBEATS = ("LTS_TIMESYNC", "LTS_NOT_FOUND")
CROSSING_KEYS = ("TAGESZEIT", "TIMEOFDAY", "LASTLAPTIMEOFDAY", "LASTPASSING", "CROSSINGTIME")
TRACK_PATTERN = "n[uü]rburgring|nordschleife"

_CAR = ", ".join(
    f"{name}: string"
    for name in (
        "STNR", "CLASSNAME", "NAME", "CAR", "LAPS", "LAP", "LASTLAPTIME", "PITSTOPCOUNT",
        *(f"S{i}TIME" for i in range(1, 6)), *(f"S{i}SPEED" for i in range(1, 6)), *CROSSING_KEYS,
    )
)
_ROOT = "PID: string, EXPORTID: string, SESSION: string, HEAT: string, HEATTYPE: string," \
    " TRACKNAME: string, TOD: string, NROFINTERMEDIATETIMES: string"
_MESSAGE = "MESSAGETIME: string, MESSAGE: string"


def _parsed(frames: DataFrame, extra: str) -> DataFrame:
    return frames.withColumn("m", F.from_json("payload", f"struct<{_ROOT}, {extra}>"))


def hundredths(text):
    return (text.try_cast("decimal(18,2)") * 100).cast("bigint")


def flatten_leaderboard(frames: DataFrame) -> DataFrame:
    """One raw lap row per car object of a leaderboard frame."""
    opened = _parsed(frames, f"RESULT: array<struct<{_CAR}>>").select(
        "event_date", "received", "frame_no", "m.EXPORTID", "m.TOD",
        F.greatest(
            F.lit(1.0),
            F.coalesce(
                F.nullif(F.col("m.NROFINTERMEDIATETIMES").try_cast("double"), F.lit(0.0)),
                F.lit(5.0),
            ),
        ).alias("n"),
        F.posexplode("m.RESULT").alias("at", "c"),
    )
    lap = F.coalesce("c.LAPS", "c.LAP").try_cast("double").cast("bigint")
    own = F.coalesce(*[F.nullif(F.col(f"c.{key}"), F.lit("")) for key in CROSSING_KEYS])
    # A clock that is there but cannot be read is unknown; only a missing one is replaced.
    told = F.nullif(F.col("TOD"), F.lit(""))
    root = F.when(told.isNotNull(), instant_clock_ms(told)).otherwise(F.col("received") % 86_400_000)

    def shown(i, col):
        return F.when(F.col("n") >= i, col)

    return opened.select(
        "event_date", "received", "frame_no", "at",
        F.col("EXPORTID").alias("event"),
        stripped("c.STNR").alias("car"),
        lap.alias("lap"),
        F.col("c.CLASSNAME").alias("klass"),
        *[shown(i, clock_ms(F.col(f"c.S{i}TIME"))).alias(f"s{i}") for i in range(1, 6)],
        *[shown(i, hundredths(F.col(f"c.S{i}SPEED"))).alias(f"v{i}") for i in range(1, 6)],
        F.when(own.isNotNull(), instant_clock_ms(own)).otherwise(root).alias("lap_end"),
        clock_ms(F.col("c.LASTLAPTIME")).alias("lap_time"),
        F.col("c.NAME").alias("driver"),
        F.col("c.CAR").alias("vehicle"),
        F.col("c.PITSTOPCOUNT").try_cast("bigint").alias("counter"),
    ).filter("car <> '' and lap is not null")


def frame_gate(frames: DataFrame, pattern: str = TRACK_PATTERN) -> DataFrame:
    """Frames that are no heartbeats and come from a matching track."""
    track = F.coalesce(F.get_json_object("payload", "$.TRACKNAME"), F.lit(""))
    return _no_heartbeats(frames).filter(track.rlike(f"(?iu){pattern}"))


def rejected_events(frames: DataFrame, pattern: str = TRACK_PATTERN) -> DataFrame:
    """Event ids of frames turned away by the gate."""
    track = F.coalesce(F.get_json_object("payload", "$.TRACKNAME"), F.lit(""))
    event = F.nullif(F.get_json_object("payload", "$.EXPORTID"), F.lit(""))
    turned = _no_heartbeats(frames).filter(~track.rlike(f"(?iu){pattern}"))
    return turned.select(event.alias("event")).filter("event is not null").distinct()


def _no_heartbeats(frames: DataFrame) -> DataFrame:
    return frames.filter(~F.coalesce("pid", F.lit("")).isin(*HEARTBEATS))


def payload_keys(frames: DataFrame, pattern: str = "%") -> DataFrame:
    """Keys that car objects carry, with the number of frames showing each."""
    cars = F.from_json(F.get_json_object("payload", "$.RESULT"), "array<string>")
    keys = F.array_distinct(F.flatten(F.transform(cars, F.json_object_keys)))
    return (
        frames.select(F.explode(keys).alias("key"))
        .filter(F.col("key").ilike(pattern))
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("frames"))
    )


def map_messages(frames: DataFrame) -> DataFrame:
    """Race-control messages of message frames; blank ones dropped."""
    opened = _parsed(frames, f"MESSAGES: array<struct<{_MESSAGE}>>").select(
        "event_date", "received", "frame_no", F.posexplode("m.MESSAGES").alias("at", "x")
    )
    text = stripped("x.MESSAGE")
    clock = stripped(F.coalesce("x.MESSAGETIME", F.lit("")))
    return opened.filter(text != "").select(
        "event_date", "received", "frame_no", "at",
        F.nullif(F.regexp_extract(text, r"#\s*(\d+)", 1), F.lit("")).alias("car"),
        text.alias("message"),
        berlin_instant(F.col("event_date"), clock).alias("created"),
        F.concat_ws("|", "event_date", clock, text).alias("ext_key"),
    )


def live_status(frames: DataFrame, held: DataFrame) -> DataFrame:
    """Per day: the latest frame's identity, the rows held, and liveness."""
    opened = _parsed(_no_heartbeats(frames), "RESULT: array<string>").filter("size(m.RESULT) > 0")
    heat = F.concat(
        F.coalesce("m.HEAT", F.lit("")),
        F.coalesce(F.concat(F.lit(" ["), "m.HEATTYPE", F.lit("]")), F.lit("")),
    )
    last = opened.groupBy("event_date").agg(
        F.max_by(
            F.struct(
                F.col("m.EXPORTID").alias("event_id"), F.col("m.SESSION").alias("session"),
                heat.alias("heat"), F.col("m.TRACKNAME").alias("track"),
            ),
            F.struct("received", "frame_no", "event"),
        ).alias("x"),
        F.max("received").alias("updated"),
    )
    rows = held.groupBy("event_date").agg(F.count(F.lit(1)).alias("cars"))
    return last.join(rows, "event_date", "full").select(
        "event_date", "x.event_id", "x.session", "x.heat", "x.track",
        F.coalesce("cars", F.lit(0)).alias("cars"), "updated",
        F.col("updated").isNotNull().alias("live"),
    )


def lap_snapshots(objects: DataFrame) -> DataFrame:
    """Raw laps from the lap-snapshot shape (JSON text in `payload`)."""
    fields = "stnr className lap s1Time s2Time s3Time s4Time s5Time todTs createdAt lapTime" \
        " driverName car".split()
    o = objects.select(
        "event_date",
        F.from_json("payload", "struct<" + ", ".join(f"{f}: string" for f in fields) + ">").alias(
            "o"
        ),
    )
    return o.select(
        "event_date",
        stripped("o.stnr").alias("car"),
        F.col("o.lap").try_cast("double").cast("bigint").alias("lap"),
        F.col("o.className").alias("klass"),
        *[clock_ms(F.col(f"o.s{i}Time")).alias(f"s{i}") for i in range(1, 6)],
        instant_clock_ms(F.coalesce("o.todTs", "o.createdAt")).alias("lap_end"),
        clock_ms(F.col("o.lapTime")).alias("lap_time"),
        F.lit(False).alias("inpit"),
        F.lit(False).alias("fastest"),
        F.col("o.driverName").alias("driver"),
        F.col("o.car").alias("vehicle"),
    ).filter("car <> '' and lap is not null")


def entry_lists(objects: DataFrame) -> DataFrame:
    """Raw laps from generic entry lists with alternative field names."""
    fields = "number startNumber no lap laps lapNumber class className timeOfDay lastCrossing" \
        " lapTime lastLap driver driverName vehicle car".split()
    shape = (
        "array<struct<" + ", ".join(f"`{f}`: string" for f in fields)
        + ", sectors: array<string>, sectorTimes: array<string>,"
        " inPit: boolean, pit: boolean, fastest: boolean, isFastest: boolean>>"
    )
    lists = F.coalesce(
        *[F.from_json(F.get_json_object("payload", f"$.{name}"), shape)
          for name in ("entries", "results", "data")]
    )
    o = objects.select("event_date", F.explode(lists).alias("o"))
    sectors = F.coalesce("o.sectors", "o.sectorTimes")
    return o.select(
        "event_date",
        stripped(F.coalesce("o.number", "o.startNumber", "o.no")).alias("car"),
        F.coalesce("o.lap", "o.laps", "o.lapNumber").try_cast("double").cast("bigint").alias("lap"),
        F.coalesce("o.class", "o.className").alias("klass"),
        *[clock_ms(F.get(sectors, i)).alias(f"s{i + 1}") for i in range(5)],
        instant_clock_ms(F.coalesce("o.timeOfDay", "o.lastCrossing")).alias("lap_end"),
        clock_ms(F.coalesce("o.lapTime", "o.lastLap")).alias("lap_time"),
        F.coalesce("o.inPit", "o.pit", F.lit(False)).alias("inpit"),
        F.coalesce("o.fastest", "o.isFastest", F.lit(False)).alias("fastest"),
        F.coalesce("o.driver", "o.driverName").alias("driver"),
        F.coalesce("o.vehicle", "o.car").alias("vehicle"),
    ).filter("car <> '' and lap is not null")


def map_lap_objects(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """Both object shapes as one set of raw laps."""
    return lap_snapshots(snapshots).unionByName(entry_lists(entries), allowMissingColumns=True)
