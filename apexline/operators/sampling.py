"""Greedy sampling of frames: at least so many ms between kept frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A slice holds at most this many distinct instants, however many frames it gets.
SLICE_MS = 3_600_000
_CHANNEL = ["event_date", "channel"]


def _last_reached(follow: np.ndarray) -> np.ndarray:
    """For each instant, the last one of a slice that is kept if it is: its successors' end, by pointer doubling."""
    here = np.arange(len(follow))
    reach = np.where(follow < len(follow), follow, here)
    while True:
        further = reach[reach]
        if (further == reach).all():
            return reach
        reach = further


def _reached(follow: np.ndarray, first: int) -> np.ndarray:
    """All instants kept from `first` on; each step doubles how many successors are known."""
    kept = np.zeros(len(follow) + 1, bool)
    kept[first] = True
    jump = np.append(follow, len(follow))
    while jump[first] < len(follow):
        kept[jump[np.flatnonzero(kept)]] = True
        jump = jump[jump]
    # What jumps over the end has been collected by the shorter ones; one more round closes the gap.
    kept[jump[np.flatnonzero(kept)]] = True
    return np.flatnonzero(kept[:-1])


def _slice_exits(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each possible first kept frame of a slice, the last kept one.

    The last kept frame lies before the slice, so the first kept one here is
    less than a gap after the slice's first frame, or the next frame after that.
    """
    last = _last_reached(np.searchsorted(times, times + gap))
    entries = min(int(np.searchsorted(times, times[0] + gap)) + 1, len(times))
    # Neighbouring entries with the same exit are one step of the function.
    ends = np.flatnonzero(np.append(last[1:entries] != last[: entries - 1], True))
    return times[ends], times[last[ends]]


def sample_frames(
    frames: DataFrame, min_ms: int = 15_000, channel: str = "pid", held: DataFrame | None = None,
    slice_ms: int = SLICE_MS,
) -> DataFrame:
    """Per day and channel, keep a frame iff min_ms passed since the last kept.

    Greedy, hence order-dependent. Frames reduce to distinct instants, and these to
    slices: the next instant that may be kept is a function on a slice, whose powers come
    by pointer doubling. Each slice tells which exit follows from which entry, the slices of
    a channel are composed on those steps alone, and each slice then lists what it keeps.
    Payloads take part in the last join only.

    held: event_date, channel and the last kept instant of earlier runs.
    """
    keyed = frames.withColumn("channel", F.coalesce(channel, F.lit("?")))
    if min_ms <= 0:
        return keyed.drop("channel")
    if held is None:
        held = keyed.select(*_CHANNEL, F.col("received").alias("last")).limit(0)
    else:
        keyed = (
            keyed.join(held.select(*_CHANNEL, "last"), _CHANNEL, "left")
            .filter("last is null or received > last")
            .drop("last")
        )
    parts = [*_CHANNEL, "slice"]
    instants = keyed.withColumn("slice", F.expr(f"received div {slice_ms}")).select(
        *parts, "received"
    ).distinct()

    types = "event_date string, channel string"

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["received"].to_numpy())
        upto, leave = _slice_exits(times, min_ms)
        head = pdf.iloc[[0] * len(upto)][parts].reset_index(drop=True)
        return head.assign(upto=upto, leave=leave, first=times[0])

    def chain(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        need = None if right.empty else int(right["last"].iloc[0]) + min_ms
        for number, part in left.sort_values(["slice", "upto"]).groupby("slice", sort=True):
            rows.append((number, need if need is not None else int(part["first"].iloc[0])))
            reached = np.searchsorted(part["upto"].to_numpy(), rows[-1][1])
            if reached < len(part):
                need = int(part["leave"].iloc[reached]) + min_ms
        out = pd.DataFrame(rows, columns=["slice", "need"]).astype("int64")
        return out.assign(event_date=key[0], channel=key[1])

    def keep(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(left["received"].to_numpy())
        first = int(np.searchsorted(times, int(right["need"].iloc[0]))) if len(right) else len(times)
        if first >= len(times):
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in _CHANNEL} | {"received": pd.Series([], dtype="int64")})
        kept = times[_reached(np.searchsorted(times, times + min_ms), first)]
        return pd.DataFrame({"event_date": key[0], "channel": key[1], "received": kept})

    earlier = held.select(*_CHANNEL, "last").groupBy(*_CHANNEL)
    entered = (
        instants.groupBy(*parts)
        .applyInPandas(steps, f"{types}, slice bigint, upto bigint, leave bigint, first bigint")
        .groupBy(*_CHANNEL)
        .cogroup(earlier)
        .applyInPandas(chain, f"slice bigint, need bigint, {types}")
    )
    kept = (
        instants.groupBy(*parts)
        .cogroup(entered.groupBy(*parts))
        .applyInPandas(keep, f"{types}, received bigint")
    )
    # Of several frames at a kept instant the first one is it.
    found = keyed.join(kept, [*_CHANNEL, "received"], "left_semi")
    order = F.struct("frame_no", "event")
    rest = F.struct(*[F.col(c) for c in frames.columns])
    return (
        found.groupBy(*_CHANNEL, "received").agg(F.min_by(rest, order).alias("x")).select("x.*")
    )
