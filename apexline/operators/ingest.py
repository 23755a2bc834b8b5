"""Cleaning of raw laps and frames before anything is derived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.ordered import previous, scan

SECTOR_CAP = 900_000_000
LAP_CAP = 3_600_000_000


def repair_dropped_sector(laps: DataFrame, longest: int = SECTOR_CAP) -> DataFrame:
    """Fill the one missing sector of S1..S4 from the lap time, when plausible."""
    interior = F.slice("s", 1, 4)
    missing = F.size(F.filter(interior, lambda x: x.isNull()))
    known = F.aggregate(
        "s", F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x, F.lit(0))
    )
    hole = F.col("rt") - known
    fits = (
        (missing == 1) & F.col("s")[4].isNotNull() & (F.col("rt") != 0)
        & (hole > 0) & (hole < longest)
    )
    return laps.withColumn(
        "s",
        F.when(
            fits,
            F.transform("s", lambda x, i: F.when(i < 4, F.coalesce(x, hole)).otherwise(x)),
        ).otherwise(F.col("s")),
    )


KEY = ["event", "car", "lap"]
SIGNATURE = ["s1", "s2", "s3", "s4", "s5", "lap_time", "tend", "inpit"]


def merge_latest_rows(log: DataFrame) -> DataFrame:
    """One row per (event, car, lap): the version received last.

    An aggregate, so versions of one row are reduced before they are shuffled.
    """
    rest = [c for c in log.columns if c not in KEY]
    # Equal arrival times are told apart by the row itself.
    last = F.max(F.struct("received", F.struct(*[c for c in rest if c != "received"]).alias("r")))
    return log.groupBy(*KEY).agg(last.alias("_x")).select(*KEY, "_x.received", "_x.r.*")


def changed_rows(log: DataFrame, hot: bool | None = None) -> DataFrame:
    """Versions whose signature differs from the version before."""
    signed = log.withColumn("_sig", F.struct(*SIGNATURE))
    # Versions of one instant stand in the order of their frames, and of places in a frame.
    order = ["received", *[c for c in ("frame_no", "at") if c in log.columns]]
    seen = scan(signed, KEY, order, {"_prev": previous("_sig")}, hot)
    return seen.filter(~F.col("_sig").eqNullSafe(F.col("_prev"))).drop("_sig", "_prev")


def pit_from_counter(seen: DataFrame, hot: bool | None = None) -> DataFrame:
    """Laps on which a car's stop counter rose over the frame before."""
    ties = [c for c in ("frame_no", "at") if c in seen.columns]
    counted = seen.filter("counter is not null").select(*KEY, "received", *ties, "counter")
    steps = scan(
        counted, ["event", "car"], ["received", "lap", *ties], {"_prev": previous("counter")}, hot
    )
    return steps.filter("counter > _prev").select(*KEY).distinct()


def dedup_frames(frames: DataFrame) -> DataFrame:
    """Identical payloads of a day and channel once; the first received stays."""
    channel = F.coalesce("pid", F.lit("?")).alias("pid")
    rest = F.struct(*[c for c in frames.columns if c not in ("event_date", "pid")])
    return (
        frames.groupBy("event_date", channel, F.sha2("payload", 256).alias("body_hash"))
        .agg(F.min_by(rest, F.struct("received", "frame_no", "event")).alias("x"))
        .select("event_date", "pid", "body_hash", "x.*")
    )


def merge_messages(messages: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Messages to insert: first of each key not held yet; keyless ones always."""
    keyed = messages.filter("ext_key is not null")
    rest = [c for c in messages.columns if c != "ext_key"]
    first = (
        keyed.groupBy("ext_key")
        .agg(F.min_by(F.struct(*rest), F.struct("received", "frame_no", "at")).alias("x"))
        .select("ext_key", "x.*")
    )
    if held is not None:
        first = first.join(held.select("ext_key").distinct(), "ext_key", "left_anti")
    return first.unionByName(messages.filter("ext_key is null"))


def null_implausible(
    laps: DataFrame, sector_cap: int = SECTOR_CAP, lap_cap: int = LAP_CAP
) -> DataFrame:
    """Sector and lap times over their caps become unknown."""
    return laps.withColumns(
        {
            "s": F.transform("s", lambda x: F.when(x <= sector_cap, x)),
            "rt": F.when(F.col("rt") <= lap_cap, F.col("rt")),
        }
    )


def _with_next(laps: DataFrame) -> DataFrame:
    """The lap time shown on the row of the next lap; a join, as laps are unique."""
    after = laps.select("event", "car", (F.col("lap") - 1).alias("lap"), F.col("rt").alias("_next"))
    return laps.join(after, KEY, "left")


def shift_lap_time(laps: DataFrame) -> DataFrame:
    """The feed shows a lap's time on the row after it; move it back."""
    marked = laps.select(
        "event", "car", (F.col("lap") - 1).alias("lap"), F.col("rt").alias("_next"),
        F.lit(True).alias("_has_next"),
    )
    return (
        laps.join(marked, KEY, "left")
        .withColumn("rt", F.when(F.col("_has_next"), F.col("_next")).otherwise(F.col("rt")))
        .drop("_next", "_has_next")
    )


def backfill_last_sector(laps: DataFrame) -> DataFrame:
    """Missing S5 = lap time shown one row later - (S1 + S2 + S3 + S4).

    Runs before shift_lap_time.
    """
    first_four = F.aggregate(F.slice("s", 1, 4), F.lit(0).cast("bigint"), lambda a, x: a + x)
    filled = F.coalesce(F.col("s")[4], F.col("_next") - first_four)
    return (
        _with_next(laps)
        .withColumn("s", F.transform("s", lambda x, i: F.when(i < 4, x).otherwise(filled)))
        .drop("_next")
    )


def prune_frames(
    frames: DataFrame, archived_days: DataFrame, now_ms: int, keep_days: int = 21
) -> tuple[DataFrame, DataFrame]:
    """Split frames into kept and prunable: old ones of archived days."""
    old = F.col("received") < now_ms - keep_days * 86_400_000
    marked = archived_days.select("event_date").distinct().withColumn("_archived", F.lit(True))
    both = frames.join(marked, "event_date", "left").withColumn(
        "_gone", old & F.coalesce("_archived", F.lit(False))
    )
    gone = both.filter("_gone").drop("_gone", "_archived")
    return both.filter("not _gone").drop("_gone", "_archived"), gone
