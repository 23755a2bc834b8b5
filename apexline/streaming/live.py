"""The live feed as streaming queries.

A stream of frames has event_date, pid, frame_no, event, received (ms) and
payload. What a query must know of earlier batches is keyed state, so a batch
reads nothing that was written before it, and no file or folder is listed. State
of a key that nothing has arrived for goes after KEEP_MS.

Tables are folders of days, and inside a day of micro-batches; a batch that runs
again overwrites its own folders, whatever the number of tasks that write them.
Reading a table merges its rows, so an upsert is an append, and what a table holds
does not depend on the order in which frames arrive, nor on state that has gone.
`compact` rewrites days once they are over.
"""

from __future__ import annotations

import pickle
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from apexline.functions.session import cut
from apexline.operators.ingest import KEY, merge_messages, pit_from_counter
from apexline.operators.sampling import sample_frames
from apexline.sources import frames as feed

FRAME_SCHEMA = (
    "event_date string, pid string, frame_no bigint, event string, received bigint, payload string"
)
FLUSH = "5 seconds"
# A day and a half after the last arrival an event day is over.
KEEP_MS = 36 * 3_600_000
# Stop counters of a car are held by the hour.
SLICE_MS = 3_600_000
# Groups that the keys of a stream are dealt to. A checkpoint is bound to their number.
BUCKETS = 256


def read_frames(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Frames arriving as JSON files."""
    return (
        spark.readStream.schema(FRAME_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )


def _no_frames(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FRAME_SCHEMA)


def _appended(
    rows: DataFrame, path: str, checkpoint: str, once: bool, made=None, gathered: bool = True
) -> StreamingQuery:
    """Append each batch of a stream, or what `made` makes of it, to its days.

    gathered: rows, which must be narrow, go to their days first, so that a batch writes one file a day and not one for
    each task and day.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        part = (made(batch) if made else batch).withColumn("batch", F.lit(batch_id))
        if gathered:
            part = part.repartition("event_date")
        writer = part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("event_date", "batch").parquet(path)

    trigger = {"availableNow": True} if once else {"processingTime": FLUSH}
    writer = rows.writeStream.outputMode("append").foreachBatch(write)
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).drop("batch")


def _fields(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *more])


def _keyed(rows: DataFrame, keys: list[str], step, out: str, expires: bool) -> DataFrame:
    """Rows through a step per key: (key, rows as tuples, held tuple or None, now) to (rows out, held).

    Keys are dealt to BUCKETS by a hash; a bucket's state is the packed map of its keys to (last arrival, held), so
    that what a call of Python costs is paid once a bucket and batch, not once a key. A key that nothing has arrived
    for in KEEP_MS goes when its bucket is opened next, and a bucket without arrivals as a whole.
    A run that ends once all is read has no state that expires: with it there would always be another batch.
    """
    names = [n.split()[0].strip("`") for n in out.split(", ")]
    at = [rows.columns.index(k) for k in keys]

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentProcessingTimeMs()
        held = pickle.loads(zlib.decompress(state.get[0])) if state.exists else {}
        if expires:
            held = {k: v for k, v in held.items() if now - v[0] < KEEP_MS}
        given: dict[tuple, list] = {}
        for pdf in frames:
            for row in _tuples(pdf.drop(columns="_bucket")):
                given.setdefault(tuple(row[k] for k in at), []).append(row)
        found = []
        for key, mine in given.items():
            told, after = step(key, mine, held[key][1] if key in held else None, now)
            found += told
            if after is not None:
                held[key] = (now, after)
        if held:
            state.update((zlib.compress(pickle.dumps(held, pickle.HIGHEST_PROTOCOL), 1),))
            if expires:
                state.setTimeoutDuration(KEEP_MS)
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=names, dtype=object)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if expires else GroupStateTimeout.NoTimeout
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").applyInPandasWithState(run, out, "held binary", "append", timeout)


def _tuples(pdf: pd.DataFrame) -> Iterator[tuple]:
    """Rows with None for what is missing and whole numbers as such."""
    columns = []
    for name in pdf.columns:
        col = pdf[name]
        values = col.astype(object).where(col.notna(), None)
        columns.append([int(v) if isinstance(v, float) else v for v in values])
    return zip(*columns)


# ---- timing ------------------------------------------------------------------


def timing_rows(frames: DataFrame) -> DataFrame:
    """Cleaned raw lap rows of accepted leaderboard frames."""
    return feed.flatten_leaderboard(feed.frame_gate(frames)).drop("at")


# What tells when a row was shown, beside the time.
_PLACE = ["event_date", "frame_no"]


def _rank(values: tuple) -> tuple:
    """Order of the batch merge: field by field, missing before all else."""
    return tuple((v is not None, v) for v in values)


def timing_changes(rows: DataFrame, expires: bool = True) -> DataFrame:
    """Versions of lap rows that are newer than all before them and differ from the newest one.

    Of an unchanged row that is shown again only the time is told (`of` is the time of the version it
    repeats), at most once a key and batch; of an older row that comes late nothing is. State is the
    newest version of each (event, car, lap) and when it was last seen.
    """
    names = rows.columns
    rest = [n for n in names if n not in (*KEY, "received")]
    when = names.index("received")
    at = [names.index(n) for n in rest]
    # Time and frame are no content.
    content = [k for k, n in enumerate(rest) if n not in _PLACE]
    plain = [k for k, n in enumerate(names) if n in (*KEY, "received", *_PLACE)]

    def rank(row):
        return row[when], _rank([row[k] for k in at])

    def step(key, given, held, _):
        best = max(given, key=rank)
        mine = tuple(best[k] for k in at)
        if held is not None:
            of, old = held[1], tuple(held[2:])
            if rank(best) <= (held[0], _rank(old)):
                return [], tuple(held)
            if [mine[k] for k in content] == [old[k] for k in content]:
                shown = [best[k] if k in plain else None for k in range(len(names))]
                return [(*shown, of, True)], (best[when], of, *mine)
        return [(*best, best[when], False)], (best[when], best[when], *mine)

    return _keyed(rows, KEY, step, _fields(rows, "of bigint", "again boolean"), expires)


def stream_timing(
    frames: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append the changed lap rows of each batch to path/rows."""
    return _appended(timing_changes(timing_rows(frames), not once), f"{path}/rows", checkpoint, once)


def merged_changes(changes: DataFrame) -> DataFrame:
    """Changes of lap rows to one row each: the newest version, and where it was seen last."""
    rest = [c for c in changes.columns if c not in (*KEY, "received", "of", "again", *_PLACE)]
    version = F.struct("received", *_PLACE, F.struct(*rest).alias("r"))
    # Each version with the last place that it was seen at, then the newest.
    seen = changes.groupBy(*KEY, "of").agg(
        F.max(F.when(~F.col("again"), version)).alias("v"), F.max(F.struct("received", *_PLACE)).alias("p")
    )
    last = F.max(F.struct("p", "of", "v"))
    return seen.filter("v is not null").groupBy(*KEY).agg(last.alias("x")).select(
        *KEY, "x.p.*", "x.v.r.*", "x.of", F.col("x.v").alias("v")
    )


def _changes(spark: SparkSession, path: str) -> DataFrame:
    rows = timing_rows(_no_frames(spark))
    return _stored(spark, f"{path}/rows", _fields(rows, "of bigint", "again boolean"))


def read_timing(spark: SparkSession, path: str, pits: str | None = None) -> DataFrame:
    """The timing table: the last version of each lap row.

    pits: folder of stream_pit_counter; then `inpit` tells whether the lap ended in the pits, as the stop
    counters of all frames show it.
    """
    table = merged_changes(_changes(spark, path)).drop("of", "v")
    if pits is None:
        return table
    flags = read_pit_laps(spark, pits).withColumn("inpit", F.lit(True))
    return table.join(flags, KEY, "left").withColumn("inpit", F.coalesce("inpit", F.lit(False)))


def compact_timing(spark: SparkSession, path: str, day: str) -> None:
    """Rewrite a day's changes as one row a lap; readers see the same table at every moment."""
    changes = _changes(spark, path)
    last = merged_changes(changes.filter(F.col("event_date") == day))
    # The version as it was told first, and the last time it was seen.
    told = last.withColumns({n: F.col(f"v.{n}") for n in ["received", *_PLACE]} | {"again": F.lit(False)})
    content = [c for c in changes.columns if c not in (*KEY, "received", "of", "again", *_PLACE)]
    rows = told.select(changes.columns)
    later = last.withColumn("again", F.lit(True)).filter(F.struct("received", *_PLACE) > F.struct("v.received", *[f"v.{n}" for n in _PLACE]))
    blank = [F.lit(None).cast(changes.schema[c].dataType).alias(c) if c in content else F.col(c) for c in changes.columns]
    _rewritten(rows.unionByName(later.select(*blank)), f"{path}/rows", day)


# ---- status ------------------------------------------------------------------


def stream_status(frames: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the identity of each batch's last frame of a day: the sign of life, changed rows or not."""
    return _appended(
        frames, f"{path}/status", checkpoint, once,
        lambda batch: feed.live_status(batch, batch.select("event_date").limit(0)).drop("cars", "live"),
    )


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Per day: the latest frame's identity, the lap rows held, and liveness."""
    empty = _no_frames(spark)
    shape = feed.live_status(empty, empty).drop("cars", "live")
    last = _stored(spark, f"{path}/status", shape.schema).groupBy("event_date").agg(
        F.max_by(F.struct("event_id", "session", "heat", "track"), "updated").alias("x"), F.max("updated").alias("updated")
    )
    held = read_timing(spark, path).groupBy("event_date").agg(F.count(F.lit(1)).alias("cars"))
    return last.join(held, "event_date", "full").select(
        "event_date", "x.event_id", "x.session", "x.heat", "x.track",
        F.coalesce("cars", F.lit(0)).alias("cars"), "updated", F.col("updated").isNotNull().alias("live"),
    )


# ---- stop counters -------------------------------------------------------------


_COUNTED = ["received", "lap", "frame_no", "at", "counter"]


def counted_rows(frames: DataFrame) -> DataFrame:
    """Stop counters as shown, one narrow row per car and frame."""
    shown = feed.flatten_leaderboard(feed.frame_gate(frames)).filter("counter is not null")
    return shown.select("event_date", *KEY, "received", "frame_no", "at", "counter")


# A counter as it is held: _COUNTED.
_SEEN = f"<{len(_COUNTED)}q"


def _runs(seen: list[tuple]) -> list[tuple]:
    """First and last of each run of equal (lap, counter), in time order."""
    new = [True, *((a[1], a[4]) != (b[1], b[4]) for a, b in zip(seen, seen[1:])), True]
    return [row for row, first, last in zip(seen, new, new[1:]) if first or last]


def counter_runs(rows: DataFrame, expires: bool = True) -> DataFrame:
    """Where a car's (lap, counter) changes, by the hour; a new version whenever a frame alters that.

    State is the hour's counters in time order. A frame that comes late, between two seen ones, is put in its place;
    if the order of laps and counters is another one then, the hour's runs are told anew, under the next version,
    which may add a pit lap or take one back. An hour whose state has gone begins a new generation.
    """

    def step(key, given, held, now):
        mine = {tuple(r[k] for k in places) for r in given}
        day = min(r[0] for r in given)
        before, version, generation = [], 0, now
        if held is not None:
            before, version, generation = list(struct.iter_unpack(_SEEN, held[0])), held[1], held[2]
            day = min(day, held[3])
        after = sorted(mine.union(before))
        if len(after) == len(before):
            return [], (held[0], version, generation, day)
        told = _order(before) != _order(after)
        version += told
        out = [(day, *key, generation, version, *r) for r in _runs(after)] if told else []
        return out, (b"".join([struct.pack(_SEEN, *r) for r in after]), version, generation, day)

    sliced = rows.withColumn("slice", F.expr(f"received div {SLICE_MS}")).select(
        "event_date", "event", "car", "slice", *_COUNTED
    )
    places = [sliced.columns.index(c) for c in _COUNTED]
    out = "event_date string, event string, car string, slice bigint, generation bigint, version bigint, " + ", ".join(
        f"{c} bigint" for c in _COUNTED
    )
    return _keyed(sliced, ["event", "car", "slice"], step, out, expires)


def _order(seen: list[tuple]) -> list[tuple]:
    """The laps and counters in turn."""
    told = [(r[1], r[4]) for r in seen]
    return [t for t, last in zip(told, [None, *told]) if t != last]


def stream_pit_counter(
    frames: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append the runs of laps and stop counters that a batch has changed."""
    return _appended(counter_runs(counted_rows(frames), not once), path, checkpoint, once)


def read_pit_laps(spark: SparkSession, path: str) -> DataFrame:
    """Laps on which a car's counter rose, wherever the frames before it arrived.

    A few rows a lap are read, not the counters of the frames.
    """
    hour = ["event", "car", "slice", "generation"]
    out = "event_date string, event string, car string, slice bigint, generation bigint, version bigint, "
    rows = _stored(spark, path, out + ", ".join(f"{c} bigint" for c in _COUNTED))
    # The last version's rows of each hour, collected as one bounded list.
    told = rows.groupBy(*hour, "version").agg(F.collect_set(F.struct(*_COUNTED)).alias("runs"))
    last = told.groupBy(*hour).agg(F.max_by("runs", "version").alias("runs"))
    runs = last.select("event", "car", F.explode("runs").alias("x")).select("event", "car", "x.*")
    return pit_from_counter(runs)


# ---- messages ------------------------------------------------------------------


def new_messages(messages: DataFrame, expires: bool = True) -> DataFrame:
    """Messages whose key has not been told, or only by later frames; those without a key all.

    State is the place of the earliest frame that told a key.
    """
    names = messages.columns
    order = [names.index(c) for c in ("received", "frame_no", "at")]
    key = names.index("ext_key")

    def step(_, given, held, now):
        if given[0][key] is None:
            return [row[:-1] for row in given], None
        best = min(given, key=lambda r: [r[k] for k in order])
        place = tuple(best[k] for k in order)
        return ([best[:-1]], place) if held is None or place < held else ([], held)

    # Keyless messages stand alone; a hash deals them.
    own = F.when(F.col("ext_key").isNull(), F.xxhash64("received", "frame_no", "at"))
    keyed = messages.withColumn("_group", own)
    instants = [f.name for f in messages.schema.fields if f.dataType.typeName() == "timestamp"]
    as_numbers = keyed.withColumns({c: F.unix_micros(c) for c in instants})
    plain = as_numbers.drop("_group")
    found = _keyed(as_numbers, ["ext_key", "_group"], step, _fields(plain), expires)
    return found.withColumns({c: F.timestamp_micros(c) for c in instants})


def stream_messages(
    frames: DataFrame, path: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Append the messages that are new, however late they come."""
    return _appended(new_messages(feed.map_messages(frames), not once), path, checkpoint, once)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The message table: the first of each key; messages without one all stay."""
    return merge_messages(_stored(spark, path, feed.map_messages(_no_frames(spark)).schema))


# ---- frame archive ---------------------------------------------------------------


def archived_frames(frames: DataFrame) -> DataFrame:
    """Frames that are no heartbeats, with a hash of their payload."""
    live = frames.filter(~F.coalesce("pid", F.lit("")).isin(*feed.HEARTBEATS))
    return live.withColumn("body_hash", F.sha2("payload", 256))


def stream_frame_archive(frames: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Land whole frames, each by the task that has read it; a query of its own, so that a failure here
    never touches the timing.

    What a late or backfilled frame is worth shows only beside its neighbours, which may arrive after it: a day
    is thinned out by `settle_frames` once it is over, and until then on reading.
    """
    return _appended(archived_frames(frames), path, checkpoint, once, gathered=False)


def _thinned(frames: DataFrame, min_ms: int) -> DataFrame:
    """Frames at least min_ms apart within a day and channel, equal payloads once."""
    kept = sample_frames(frames, min_ms)
    rest = F.struct(*[F.col(c) for c in kept.columns])
    return kept.groupBy("event_date", F.coalesce("pid", F.lit("?")).alias("_c"), "body_hash").agg(
        F.min_by(rest, F.struct("received", "frame_no", "event")).alias("x")
    ).select("x.*")


def read_frame_archive(spark: SparkSession, path: str, min_ms: int = 15_000) -> DataFrame:
    """The archive's frames; days that are settled and days that are not look alike."""
    return _thinned(_stored(spark, path, archived_frames(_no_frames(spark)).schema), min_ms)


def settle_frames(spark: SparkSession, path: str, day: str, min_ms: int = 15_000) -> None:
    """Rewrite a day that is over as the frames that stay; what came twice or too close goes.

    A frame that arrives after this is judged against those that stayed.
    """
    landed = _stored(spark, path, archived_frames(_no_frames(spark)).schema)
    _rewritten(_thinned(landed.filter(F.col("event_date") == day), min_ms), path, day)


def _rewritten(rows: DataFrame, path: str, day: str) -> None:
    """Put a day's merged rows in place of its batches.

    The merged rows are written beside the batches first, and only the batches seen before that are removed, so a
    run that breaks off, and a batch that arrives meanwhile, do no harm: reading merges again.
    """
    spark = rows.sparkSession
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/event_date={day}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return
    before = [s.getPath() for s in files.listStatus(folder)]
    held = cut(rows)
    taken = [int(p.getName().split("=")[1]) for p in before]
    # Below all others, and not among them.
    merged = held.drop("event_date").coalesce(1 + held.rdd.getNumPartitions() // 8)
    merged.write.mode("overwrite").parquet(f"{path}/event_date={day}/batch={min([0, *taken]) - 1}")
    for old in before:
        files.delete(old, True)
