"""From the live table to the timeline: one shape of raw laps, pit flags, and the feed's clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.operators import ingest

KEY = ["event", "car", "lap"]


def raw_laps(rows: DataFrame, pit_laps: DataFrame | None = None) -> DataFrame:
    """Feed rows (s1..s5, v1..v5, lap_end, lap_time) in the shape that the timeline takes.

    pit_laps: event, car, lap of laps that end in the pits, as the stop counter tells them.
    """
    laps = rows.select(
        *KEY, "klass",
        F.array(*[F.col(f"s{i}") for i in range(1, 6)]).alias("s"),
        F.array(*[F.col(f"v{i}") for i in range(1, 6)]).alias("spd"),
        F.col("lap_end").alias("tend"), F.col("lap_time").alias("rt"), "driver", "vehicle",
    )
    if pit_laps is None:
        return laps.withColumn("inpit", F.lit(False))
    flags = pit_laps.select(*KEY).distinct().withColumn("inpit", F.lit(True))
    return laps.join(flags, KEY, "left").withColumn("inpit", F.coalesce("inpit", F.lit(False)))


def clean_live(laps: DataFrame, sector_cap: int = 900_000, lap_cap: int = 3_600_000) -> DataFrame:
    """Implausible times out, missing last sectors back, lap times to their own lap, one hole filled.

    In this order: the last sector is found from the time still shown on the row after it.
    """
    plausible = ingest.null_implausible(laps, sector_cap, lap_cap)
    own = ingest.shift_lap_time(ingest.backfill_last_sector(plausible))
    return ingest.repair_dropped_sector(own, sector_cap)
