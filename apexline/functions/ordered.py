"""Ordered computations per key that stay parallel when one key is huge.

A window function sends each key to one task. That is right while every key is
moderate, and it is what `scan` does then. When a key exceeds the session's
`spark.apexline.hotRows`, `scan` cuts the rows into ranges of (keys, order)
with Spark's range partitioner, runs the windows inside each range, reduces a
range to one row per key, and carries the running state of earlier ranges in
with a join. Both ways give the same rows.

`order` must be a total order inside a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apexline.functions.session import cut, hot_rows

# Finer bins in each pass of a median: 2 ** BIN_BITS for one.
BIN_BITS = 16
_ALL_BEFORE = (Window.unboundedPreceding, -1)
_ALL_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class Running:
    """One column to compute along the order of a key."""

    kind: str
    value: str | None = None
    before: bool = False
    ties: tuple[str, ...] = ()


def number() -> Running:
    """1, 2, 3, ... along the order."""
    return Running("number")


def rank(*ties: str) -> Running:
    """Rank by the leading order columns `ties`; equal values share a rank."""
    return Running("rank", ties=ties)


def total(value: str, before: bool = False) -> Running:
    """Running sum, of earlier rows only when `before`."""
    return Running("sum", value, before)


def lowest(value: str, before: bool = False) -> Running:
    return Running("min", value, before)


def highest(value: str, before: bool = False) -> Running:
    return Running("max", value, before)


def latest(value: str, before: bool = False) -> Running:
    """Last non-null value so far."""
    return Running("last", value, before)


def previous(value: str) -> Running:
    """Value of the row before."""
    return Running("lag", value)


def following(value: str) -> Running:
    """Value of the row after."""
    return Running("lead", value)


def has_hot_group(df: DataFrame, keys: Sequence[str]) -> bool:
    """Does any key hold more rows than one task should sort?"""
    limit = hot_rows(df.sparkSession)
    if not keys:
        return df.select(F.lit(1)).limit(limit + 1).count() > limit
    return not df.groupBy(*keys).count().filter(F.col("count") > limit).isEmpty()


def _local(spec: Running, keys: list[str], order: list[str]) -> Column:
    window = Window.partitionBy(*keys).orderBy(*order)
    framed = window.rowsBetween(*(_ALL_BEFORE if spec.before else _ALL_TO_HERE))
    if spec.kind == "number":
        return F.row_number().over(window).cast("bigint")
    if spec.kind == "rank":
        return F.rank().over(Window.partitionBy(*keys).orderBy(*spec.ties)).cast("bigint")
    if spec.kind == "lag":
        return F.lag(spec.value).over(window)
    if spec.kind == "lead":
        return F.lead(spec.value).over(window)
    if spec.kind == "last":
        return F.last(spec.value, ignorenulls=True).over(framed)
    return getattr(F, spec.kind)(spec.value).over(framed)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, Running],
    hot: bool | None = None,
) -> DataFrame:
    """Add `columns`. `hot` states whether a key is too big; None looks."""
    keys, order = list(keys), list(order)
    if hot is None:
        hot = has_hot_group(df, keys)
    if hot:
        return _split_scan(df, keys, order, columns)
    return df.withColumns({name: _local(spec, keys, order) for name, spec in columns.items()})


def _split_scan(df, keys, order, columns):
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Range ids are written down: a recomputed range partitioning may cut elsewhere.
    ranged = cut(
        df.repartitionByRange(max(parts, 2), *keys, *order).withColumn(
            "_range", F.spark_partition_id()
        )
    )
    inner = [*keys, "_range"]
    local = ranged.withColumns(
        {f"_l_{name}": _local(spec, inner, order) for name, spec in columns.items()}
    )

    position = F.struct(*order)
    reduce_to = [F.count(F.lit(1)).alias("_n")]
    for name, spec in columns.items():
        if spec.kind == "rank":
            reduce_to += [
                F.max(f"_l_{name}").alias(f"_lastrun_{name}"),
                F.min(F.struct(*spec.ties)).alias(f"_first_{name}"),
                F.max(F.struct(*spec.ties)).alias(f"_end_{name}"),
            ]
        elif spec.kind == "lag":
            reduce_to.append(F.max_by(F.struct(spec.value), position).alias(f"_r_{name}"))
        elif spec.kind == "lead":
            reduce_to.append(F.min_by(F.struct(spec.value), position).alias(f"_r_{name}"))
        elif spec.kind == "last":
            known = F.when(F.col(spec.value).isNotNull(), position)
            reduce_to.append(F.max_by(spec.value, known).alias(f"_r_{name}"))
        elif spec.kind != "number":
            reduce_to.append(getattr(F, spec.kind)(spec.value).alias(f"_r_{name}"))
    ranges = local.groupBy(*inner).agg(*reduce_to)

    # One row per key and range: a key has at most as many as there are ranges.
    along = Window.partitionBy(*keys).orderBy("_range")
    so_far = along.rowsBetween(*_ALL_BEFORE)
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(so_far), F.lit(0)))
    carried = ["_before"]
    for name, spec in columns.items():
        carry = f"_c_{name}"
        if spec.kind == "number":
            continue
        if spec.kind == "rank":
            run = Window.partitionBy(*keys, f"_end_{name}")
            ranges = ranges.withColumn(
                f"_start_{name}", F.min(F.col("_before") + F.col(f"_lastrun_{name}")).over(run)
            ).withColumn(
                carry,
                F.when(
                    F.lag(f"_end_{name}").over(along) == F.col(f"_first_{name}"),
                    F.lag(f"_start_{name}").over(along),
                ),
            )
            carried += [carry, f"_first_{name}"]
        elif spec.kind == "lag":
            ranges = ranges.withColumn(carry, F.lag(f"_r_{name}").over(along))
            carried.append(carry)
        elif spec.kind == "lead":
            ranges = ranges.withColumn(carry, F.lead(f"_r_{name}").over(along))
            carried.append(carry)
        elif spec.kind == "last":
            ranges = ranges.withColumn(carry, F.last(f"_r_{name}", ignorenulls=True).over(so_far))
            carried.append(carry)
        else:
            ranges = ranges.withColumn(carry, getattr(F, spec.kind)(f"_r_{name}").over(so_far))
            carried.append(carry)

    side = ranges.select(*[F.col(k).alias(f"_k_{k}") for k in inner], *carried)
    same = F.col("_range") == F.col("_k__range")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    joined = local.join(side, same, "left")

    edge = Window.partitionBy(*inner).orderBy(*order)
    finished = {}
    for name, spec in columns.items():
        here, carry = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if spec.kind == "number":
            finished[name] = here + F.col("_before")
        elif spec.kind == "rank":
            continued = carry.isNotNull() & (F.struct(*spec.ties) == F.col(f"_first_{name}"))
            finished[name] = F.when(continued, carry).otherwise(here + F.col("_before"))
        elif spec.kind == "lag":
            first = F.row_number().over(edge) == 1
            finished[name] = F.when(first, carry[spec.value]).otherwise(here)
        elif spec.kind == "lead":
            # The row after the last one of a range opens the next range.
            final = F.lead(F.lit(1)).over(edge).isNull()
            finished[name] = F.when(final, carry[spec.value]).otherwise(here)
        elif spec.kind == "last":
            finished[name] = F.coalesce(here, carry)
        elif spec.kind == "sum":
            both = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            finished[name] = F.when(here.isNotNull() | carry.isNotNull(), both)
        elif spec.kind == "min":
            finished[name] = F.least(here, carry)
        else:
            finished[name] = F.greatest(here, carry)
    return joined.select(*df.columns, *[c.alias(name) for name, c in finished.items()])


def medians(
    df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], name: str,
    hot: bool | None = None,
) -> DataFrame:
    """Exact median of the non-null `value` per key, as twice its value.

    The doubled median of integers is an integer, so it compares exactly.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).select(*keys, value, *tie)
    if hot is None:
        hot = has_hot_group(known, keys)
    if not hot:
        return known.groupBy(*keys).agg(
            F.round(F.percentile(value, 0.5) * 2).cast("bigint").alias(name)
        )
    return _narrowed_medians(known, keys, value, name)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Do two tables agree in these columns, nulls being equal?"""
    agree = F.lit(True)
    for c in columns:
        agree &= left[c].eqNullSafe(right[f"_at_{c}"])
    return agree


def _narrowed_medians(known: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Twice the median by counting: bins of the value narrow until one value is left.

    Equal values of a key are counted once and written down; what follows works on (key, value, count). The bins of
    a pass are 2 ** BIN_BITS times finer than those of the pass before, so a key has at most 2 ** BIN_BITS of them
    inside a chosen one, and only a chosen bin's values go on. No key is sorted or numbered. The largest and smallest
    value must be less than 2 ** 63 apart.
    """
    counts = cut(known.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    low, high = counts.agg(F.min("_v"), F.max("_v")).first()
    low, high = (0, 0) if low is None else (low, high)
    passes = max(1, -(-(high - low).bit_length() // BIN_BITS))

    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    # The values wanted, by their place from 1; of an even number two in the middle.
    places = F.array(F.expr("(_n + 1) div 2"), F.expr("_n div 2 + 1"))
    targets = sizes.select(*keys, F.posexplode(places).alias("_which", "_place"))
    rows = counts.withColumn("_v", F.col("_v") - F.lit(low))
    for done in range(passes):
        bin_of = F.shiftright("_v", BIN_BITS * (passes - 1 - done))
        group = [*keys, "_bin"] if done == 0 else [*keys, "_which", "_bin"]
        binned = rows.withColumn("_bin", bin_of)
        heights = binned.groupBy(*group).agg(F.sum("_c").alias("_c"))
        # The first pass has one histogram for both places, later ones one for each.
        on = keys if done == 0 else [*keys, "_which"]
        wanted = targets.withColumnsRenamed({c: f"_at_{c}" for c in on})
        below = F.sum("_c").over(Window.partitionBy(*on).orderBy("_bin").rowsBetween(*_ALL_BEFORE))
        upto = heights.withColumn("_below", F.coalesce(below, F.lit(0)))
        hit = F.col("_place").between(F.col("_below") + 1, F.col("_below") + F.col("_c"))
        chosen = upto.join(wanted, _same(upto, wanted, on) & hit)
        which = "_which" if done == 0 else "_at__which"
        targets = chosen.select(
            *keys, F.col(which).alias("_which"), (F.col("_place") - F.col("_below")).alias("_place"), "_bin"
        )
        if done + 1 < passes:
            # A later pass starts from these twice.
            targets = cut(targets)
            side = targets.drop("_place").withColumnsRenamed({c: f"_at_{c}" for c in [*keys, "_bin"]})
            side = side.withColumnRenamed("_which", "_next")
            met = binned.join(side, _same(binned, side, [*keys, "_bin"]) & _goes_on(done))
            rows = met.select(*keys, F.col("_next").alias("_which"), "_v", "_c")
            targets = targets.drop("_bin")
    return targets.groupBy(*keys).agg((F.sum("_bin") + F.lit(2 * low)).cast("bigint").alias(name))


def _goes_on(done: int) -> Column:
    """From the second pass on, values follow the place they were chosen for."""
    return F.lit(True) if done == 0 else F.col("_which") == F.col("_next")
