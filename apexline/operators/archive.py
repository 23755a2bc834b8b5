"""Event archive: slugs, bundles, index, message board, weather at laps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.ordered import latest, number, scan
from apexline.operators.live_laps import clean_live

DAY_MS = 86_400_000
SETTLED_MS = 2 * 3_600_000
CHUNK_ROWS = 500
BOARD_ROWS = 300
# Rows of the live table as a bundle holds them.
TIMING_ROWS = (
    "car string, klass string, lap bigint, s array<bigint>, spd array<bigint>, tend bigint,"
    " rt bigint, inpit boolean, driver string, vehicle string"
)


def event_slug(events: DataFrame, rounds: DataFrame) -> DataFrame:
    """Slug: given, else of the date's round, else an "NLS n" in label or name,
    else EVT and the date.

    events: event_date, given, label, name; rounds: event_date, slug.
    """

    def numbered(col):
        digits = F.regexp_extract(F.coalesce(col, F.lit("")), r"(?i)NLS\s*0*(\d{1,2})", 1)
        return F.concat(F.lit("NLS"), F.nullif(digits, F.lit("")))

    known = rounds.select("event_date", F.col("slug").alias("_slug"))
    return events.join(known, "event_date", "left").select(
        *events.columns,
        F.coalesce(
            F.nullif("given", F.lit("")), "_slug", numbered("label"), numbered("name"),
            F.concat(F.lit("EVT-"), "event_date"),
        ).alias("slug"),
    )


def archivable_events(
    windows: DataFrame, timing: DataFrame, archived: DataFrame, now_ms: int
) -> DataFrame:
    """Dates whose last window ended over two hours ago, with timing, not archived."""
    ended = windows.groupBy("event_date").agg(
        F.max(F.coalesce("end_ts", "start_ts")).alias("last_end")
    )
    return (
        ended.filter(F.col("last_end") < now_ms - SETTLED_MS)
        .join(timing.select("event_date"), "event_date", "left_semi")
        .join(archived.select("event_date"), "event_date", "left_anti")
    )


def event_bundle(
    kinds: dict[str, tuple[DataFrame, list[str]]], hot: bool | None = None,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Snapshot of each event: every kind's rows in order, as JSON, in chunks.

    kinds: name to (rows with an event column, total order inside an event). A
    chunk holds a bounded number of rows, so no event is one record or one task.
    """
    parts = None
    for kind, (df, order) in kinds.items():
        body = F.to_json(F.struct(*[c for c in df.columns if c != "event"]))
        listed = scan(df, ["event"], order, {"_n": number()}, hot)
        chunk = listed.select(
            "event", F.lit(kind).alias("kind"),
            F.call_function("div", F.col("_n") - 1, F.lit(rows)).alias("chunk"),
            F.struct("_n", body.alias("row")).alias("_x"),
        ).groupBy("event", "kind", "chunk").agg(
            F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["row"]).alias("items")
        )
        parts = chunk if parts is None else parts.unionByName(chunk)
    return parts


def event_meta(events: DataFrame, timing: DataFrame) -> DataFrame:
    """Head of each event's bundle; an event without timing has no cars.

    events: event and what else the head tells, with slug.
    """
    cars = timing.groupBy("event").agg(F.countDistinct("car").alias("car_count"))
    return events.join(cars, "event", "left").withColumn(
        "car_count", F.coalesce("car_count", F.lit(0))
    )


def for_each_event(rows: DataFrame, events: list[str]) -> DataFrame:
    """Rows that belong to no event (tyre and band states), once for each event archived in this run."""
    return rows.select(F.explode(F.array(*map(F.lit, events))).alias("event"), "*")


def write_bundle(bundle: DataFrame, path: str) -> None:
    """Write chunks over their events' partitions; other events stay."""
    (
        bundle.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event", "kind")
        .parquet(path)
    )


def unbundle(bundle: DataFrame, kind: str, schema: str) -> DataFrame:
    """The rows of one kind again, typed by schema."""
    return (
        bundle.filter(F.col("kind") == kind)
        .select("event", F.explode("items").alias("item"))
        .select("event", F.from_json("item", schema).alias("x"))
        .select("event", "x.*")
    )


def unbundle_timing(bundle: DataFrame, sector_cap: int = 900_000, lap_cap: int = 3_600_000) -> DataFrame:
    """The bundle's laps as a replay takes them: with the live feed's clean-up, in the bundle's ticks."""
    return clean_live(unbundle(bundle, "timing", TIMING_ROWS), sector_cap, lap_cap)


def bundle_messages(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Messages of each event: those of its date; without any, undated ones in
    its time window.

    messages: id, event_date (nullable), created (ms), message; events: event,
    event_date, start_ts, end_ts (nullable).
    """
    keep = ["event", "id", "created", "message"]
    exact = messages.join(events.select("event", "event_date"), "event_date").select(*keep)
    undated = messages.filter("event_date is null and created is not null").withColumn(
        "_day", F.expr(f"created div {DAY_MS}")
    )
    # A window without an end reaches to the newest message.
    newest = undated.agg(F.coalesce(F.max("created"), F.lit(0))).scalar()
    without = events.join(
        messages.select("event_date").distinct(), "event_date", "left_anti"
    ).select("event", "start_ts", F.coalesce("end_ts", newest).alias("end_ts"))
    laid = without.filter("start_ts <= end_ts").withColumn(
        "_day", F.explode(F.expr(f"sequence(start_ts div {DAY_MS}, end_ts div {DAY_MS})"))
    )
    inside = undated.join(laid, "_day").filter("created between start_ts and end_ts").select(*keep)
    return exact.unionByName(inside)


def event_index(archived: DataFrame) -> DataFrame:
    """Archived events, newest first; stamped with the newest archive time."""
    newest = archived.agg(F.max("archived_at")).scalar()
    return archived.withColumn("generated_at", newest).orderBy(F.desc("event_date"), "slug")


def message_board(
    messages: DataFrame, day: str, race_class: str | None = None, rows: int = BOARD_ROWS
) -> DataFrame:
    """The day's newest messages that concern all classes or the chosen one."""
    shown = messages.filter(F.col("event_date") == day)
    if race_class is not None:
        shown = shown.filter(F.col("race_class").isNull() | (F.col("race_class") == race_class))
    return shown.orderBy(F.desc("created"), F.desc("id")).limit(rows)


def laps_with_weather(laps: DataFrame, weather: DataFrame, hot: bool | None = None) -> DataFrame:
    """Each lap with the latest reading at or before its end.

    laps: event, car, lap, tend, rt; weather: event, at, temp.
    """
    both = laps.select("event", "car", "lap", F.col("tend").alias("at"), "rt").withColumn(
        "_lap", F.lit(1)
    ).unionByName(
        weather.select(
            "event", "at", F.struct("at", "temp").alias("_w"), F.lit(0).alias("_lap")
        ),
        allowMissingColumns=True,
    )
    seen = scan(both, ["event"], ["at", "_lap", "car", "lap"], {"_last": latest("_w")}, hot)
    return seen.filter("_lap = 1").select(
        "event", "car", "lap", F.col("at").alias("tend"), "rt",
        F.col("_last.at").alias("recorded_at"), F.col("_last.temp").alias("temp"),
    )
