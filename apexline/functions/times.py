"""Clock texts and durations as column expressions, in whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_ms(text: Column) -> Column:
    """'h:m:s.mmm', 'm:s.mmm', 's.mmm' or German 's,mmm'; blank and '-' are null."""
    # Blank and "-" fail the cast of the last part and so are null.
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    count = F.size(parts)
    first, second = (F.get(parts, i).try_cast("bigint") for i in (0, 1))
    minutes = F.when(count == 1, 0).when(count == 2, first).when(count == 3, first * 60 + second)
    seconds = (F.element_at(parts, -1).try_cast("decimal(18,3)") * 1000).cast("bigint")
    return minutes * 60_000 + seconds


def pit_ms(text: Column) -> Column:
    """As clock_ms, with the '00.000' mark for "not recorded" read as null."""
    return F.when(F.trim(text) != "00.000", clock_ms(text))


def instant_clock_ms(value: Column) -> Column:
    """Time of day from a clock text, an epoch in ms, or an ISO instant (UTC)."""
    epoch = F.when(value.rlike(r"^\d+(\.\d+)?$"), value.try_cast("double").cast("bigint"))
    iso = F.unix_millis(F.try_to_timestamp(value))
    return F.when(value.rlike(r"^\d{1,2}:\d{2}:\d{2}"), clock_ms(value)).otherwise(
        F.pmod(F.coalesce(epoch, iso), F.lit(86_400_000))
    )


def lap_text_ms(text: Column) -> Column:
    """Milliseconds of a '[h:]m:ss.mmm' found in text; null when absent or zero."""
    found = F.regexp_extract(text, r"(?:\d+:)?\d{1,2}:\d{2}\.\d{3}", 0)
    # Hours, minutes and seconds in sixties, then the thousandths: the only three digits that come after others.
    ms = F.aggregate(
        F.split(F.translate(found, ".", ":"), ":"), F.lit(0).cast("bigint"),
        lambda sum, part: sum * F.when(F.length(part) == 3, 1000).otherwise(60) + F.concat(F.lit("0"), part).cast("bigint"),
    )
    return F.nullif(ms, F.lit(0).cast("bigint"))


def berlin_instant(day: Column, clock: Column) -> Column:
    """UTC instant in ms of a Berlin wall clock; null for a malformed clock."""
    wall = F.concat_ws(" ", day, F.lpad(clock, 8, "0"))
    stamp = F.try_to_timestamp(wall, F.lit("yyyy-MM-dd HH:mm:ss"))
    # Read the text as UTC and shift by the zone's offset at that instant.
    shifted = F.to_utc_timestamp(stamp, "Europe/Berlin")
    return F.when(clock.rlike(r"^\d{1,2}:\d{2}:\d{2}$"), F.unix_millis(shifted))
