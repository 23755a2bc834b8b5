"""Removal of repeated strings by sorted suffixes.

Every byte covered by a string of LENGTH bytes that also starts earlier (in a document with a smaller
id, or earlier in the same document) is removed. All strings are judged on the input.

Sorting a suffix per byte would multiply the corpus, so suffixes are taken at anchors: in every window of
LENGTH bytes the GRAM-byte strings with the smallest hash. Equal windows have equal anchors at equal
places, about one suffix in thirty is left, and nothing is missed.

1. Suffixes at anchors are range-partitioned by their leading bytes, with splitters from a bounded sample
   of documents. Each bucket sorts by multikey quicksort: by the leading key, then only tied runs by what
   surrounds the suffix, then by place. A suffix whose whole surroundings (every window around its anchor)
   stand earlier in the order repeats entirely: it is *covered*. One whose gram repeats in other surroundings
   is *open*: some of its windows may repeat.
2. The windows of open suffixes, each under its own smallest anchor only, are compared as a whole: windows
   are dealt out by hash, each bucket sorts them the same way, and all but the first place are repeats.
3. The spans found are brought to their documents.

Equal keys are reduced before they are dealt out: a slice of texts sends a window once, and at most two
surroundings of a gram, so no bucket grows with the number of copies. Buckets grow in number with the
corpus. Windows are compared by 96 bits of hash, surroundings by 128.

Defined cases: null and empty texts have no strings; a text is cut nowhere; rows with the same
doc_id and text get equal results and do not remove each other; rows of one doc_id, or without one, that differ in
their texts are documents of their own, told apart and ordered by 64 bits of hash (`sub`, zero where an id has one
row); a null doc_id comes before all others; texts
under LENGTH bytes keep everything; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexline.llm.common import SLICE_BYTES, repeated_ids, whole_text, with_keys

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM
# Bytes of text per bucket, of a slice that is reduced together, and of a block that is hashed together.
BUCKET_BYTES = 64 << 20
REDUCED_BYTES = 16 << 20
BLOCK_BYTES = 1 << 18
# Bounds of the sample that the splitters come from.
SAMPLE_TEXTS, SAMPLE_EACH = 512, 256

_BYTES = np.random.default_rng(100).integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.int64(-(1 << 63))


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Order by several keys; a key is only looked at inside runs that all earlier keys tie."""
    order = np.argsort(columns[0], kind="stable")
    values = columns[0][order]
    run = np.cumsum(np.r_[False, values[1:] != values[:-1]]) if len(order) else order
    for column in columns[1:]:
        at = np.flatnonzero(np.bincount(run)[run] > 1) if len(run) else run
        if not len(at):
            break
        tied = order[at]
        order[at] = tied[np.lexsort((column[tied], run[at]))]
        values = column[order]
        run = np.cumsum(np.r_[False, (run[1:] != run[:-1]) | (values[1:] != values[:-1])])
    return order


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def _later(new: np.ndarray, doc: np.ndarray, sub: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True where a row of a run stands later than the run's first row (repeated rows do not)."""
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return (doc != doc[first]) | (sub != sub[first]) | (place != place[first])


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of that many values."""
    done = 1
    while 2 * done <= width:
        values = pick(values[: len(values) - done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


class Block:
    """Texts of at least LENGTH bytes, laid end to end, with their hashes and anchors."""

    def __init__(self, texts: list[bytes]):
        self.bytes = b"".join(texts)
        data = np.frombuffer(self.bytes, np.uint8)
        sizes = np.array([len(t) for t in texts])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        grams, width = _BYTES[data], 1
        while width < GRAM:
            longer = grams[:-width] * _power(width)
            longer += grams[width:]
            grams, width = longer, 2 * width
        self.grams = (grams ^ (grams >> np.uint64(31))) * _MIX
        self.small = (self.grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.inside = np.ones(len(data) - LENGTH + 1, bool)
        for end in self.ends[:-1].tolist():
            self.inside[end - LENGTH + 1 : end] = False

    def anchors(self) -> np.ndarray:
        least = _slide(self.small, REACH + 1, np.minimum)
        least[~self.inside] = 0
        edge = np.zeros(REACH, np.uint32)
        return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), REACH + 1, np.maximum) == self.small)

    def own_anchor(self) -> np.ndarray:
        """Each window's first anchor of the smallest hash."""
        coded = self.small.astype(np.uint64) << np.uint64(32) | np.arange(len(self.small), dtype=np.uint64)
        return (_slide(coded, REACH + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def suffixes(self):
        """Text number, place, leading key and surroundings of every anchor."""
        from xxhash import xxh64_intdigest

        at = self.anchors()
        text = np.searchsorted(self.starts, at, side="right") - 1
        low = np.maximum(at - REACH, self.starts[text])
        high = np.minimum(at + LENGTH, self.ends[text])
        around = np.fromiter(
            (xxh64_intdigest(self.bytes[i:j]) for i, j in zip(low.tolist(), high.tolist())), np.uint64, len(at)
        )
        around += (at - low).astype(np.uint64) * _ODD
        data = np.frombuffer(self.bytes, np.uint8).astype(np.uint64)
        lead = data[at] << np.uint64(56) | data[at + 1] << np.uint64(48) | data[at + 2] << np.uint64(40)
        lead |= self.grams[at] >> np.uint64(24)
        return text, at - self.starts[text], lead, around

    def windows(self, covered: np.ndarray, open_: np.ndarray):
        """Text number, place, hash and tag of the windows to compare; both marks are places here."""
        own = self.own_anchor()
        marks = np.zeros(len(self.small), bool)
        marks[open_] = True
        counts = np.zeros(len(self.small) + 1, np.int32)
        counts[1:] = np.cumsum(np.bincount(covered, minlength=len(self.small)))
        n = len(own)
        free = counts[REACH + 1 : REACH + 1 + n] == counts[:n]
        at = np.flatnonzero(self.inside & marks[own] & free)
        # Three grams and a bit cover a window: four overlapping ones are hashed together.
        value = self.grams[at]
        for k in (GRAM, 2 * GRAM, LENGTH - GRAM):
            value = (value ^ (value >> np.uint64(29))) * _ODD + self.grams[at + k]
        value = (value ^ (value >> np.uint64(32))) * _MIX
        tag = (self.grams[own[at]] & np.uint64(0x7FFFFFFF)).astype(np.int32)
        text = np.searchsorted(self.starts, at, side="right") - 1
        return text, at - self.starts[text], value, tag


def _blocks(rows: list[tuple]):
    """Rows whose second item is a text of at least LENGTH bytes, in groups of about BLOCK_BYTES."""
    held, size = [], 0
    for row in rows:
        if len(row[1]) >= LENGTH:
            held.append(row)
            size += len(row[1])
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _grouped(batches, limit: int):
    """Rows of Arrow batches with texts in the second column, in groups of about `limit` bytes."""
    held, size = [], 0
    for batch in batches:
        columns = [c.cast(pa.binary()) if k == 1 else c for k, c in enumerate(batch.columns)]
        for k in range(batch.num_rows):
            row = tuple(c[k].as_py() for c in columns)
            held.append((row[0], row[1] or b"", *row[2:]))
            size += len(held[-1][1])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _joined(parts: list[tuple], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]).astype(k) for i, k in enumerate(kinds)]


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))


def _dealt(bucket: np.ndarray, count: int, columns: list[np.ndarray], riding: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with what goes there; the riding columns go along with one of the rows."""
    # In order of document and place, which come last, a bucket's numbers are alike and pack well.
    order = np.lexsort((*columns[:-4:-1], bucket))
    found, begins = np.unique(bucket[order], return_index=True)
    ends = np.r_[begins[1:], len(order)] if len(found) else np.zeros(0, int)
    if not len(found):
        found, ends = np.array([0]), np.array([0])
    rides = int(riding[0][0]) % len(found) if len(riding[0]) else 0
    rest = [np.where(np.arange(len(found)) < rides, 0, len(r)) for r in riding]
    arrays = [pa.array(found.astype(np.int32))]
    arrays += [_lists(c[order], ends) for c in columns]
    arrays += [_lists(r, e) for r, e in zip(riding, rest)]
    return pa.RecordBatch.from_arrays(arrays, [f"c{k}" for k in range(len(arrays))])


def _whole(batches, kinds: tuple) -> list[np.ndarray]:
    """All of a bucket's list columns, joined."""
    parts = [[] for _ in kinds]
    for batch in batches:
        for k in range(len(kinds)):
            parts[k].append(batch.column(k + 1).flatten().to_numpy(zero_copy_only=False))
    return [np.concatenate([np.zeros(0, kind), *p]).astype(kind) for kind, p in zip(kinds, parts)]


_COVERED, _OPEN = 1, 2
_SUFFIX = (np.int64, np.int64, np.int64, np.int64, np.int32)
_MARK = (np.int64, np.int64, np.int32, np.int8)
_WINDOW = (np.int64, np.int32, np.int64, np.int64, np.int32)
_SPAN = (np.int64, np.int64, np.int32, np.int32)


def _reduced_suffixes(lead, around, doc, sub, place):
    """Which rows to deal out, and marks (doc, sub, place, mark) that are certain already."""
    order = multikey_order([lead, around, doc, sub, place])
    lead, around, doc, sub, place = (c[order] for c in (lead, around, doc, sub, place))
    new = _changes(lead, around)
    group = np.cumsum(_changes(lead)) - 1
    number = np.cumsum(new)
    first = np.full(group[-1] + 1 if len(group) else 0, 0)
    first[group[::-1]] = number[::-1]
    nth = number - first[group] if len(group) else number
    dealt = new & (nth < 2)
    sure = _later(new, doc, sub, place) | (new & ~dealt)
    mark = np.where(new, _OPEN, _COVERED).astype(np.int8)[sure]
    return [c[dealt] for c in (lead, around, doc, sub, place)], [doc[sure], sub[sure], place[sure], mark]


def _marked(batches):
    """Marks of a bucket's suffixes, and those that ride along."""
    lead, around, doc, sub, place, *riding = _whole(batches, _SUFFIX + _MARK)
    lead = lead.view(np.uint64)
    order = multikey_order([lead, around, doc, sub, place])
    lead, around, doc, sub, place = (c[order] for c in (lead, around, doc, sub, place))
    new = _changes(lead, around)
    group = np.cumsum(_changes(lead)) - 1
    mixed = (np.bincount(group, weights=new) > 1)[group] if len(group) else new
    mark = np.where(_later(new, doc, sub, place), _COVERED, np.where(new & mixed, _OPEN, 0)).astype(np.int8)
    kept = mark > 0
    out = [np.concatenate([a, b]) for a, b in zip((doc[kept], sub[kept], place[kept], mark[kept]), riding)]
    for k in range(0, len(out[0]), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 18)]) for c in out], ["doc", "sub", "place", "mark"])


def _runs(doc: np.ndarray, sub: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Spans of windows that start at these places; neighbours are joined."""
    order = np.lexsort((place, sub, doc))
    doc, sub, place = doc[order], sub[order], place[order]
    new = _changes(doc, sub, place - np.arange(len(place)))
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(place)] - 1 if len(begin) else begin
    return [doc[begin], sub[begin], place[begin].astype(np.int32), (place[end] + LENGTH).astype(np.int32)]


def _merged(doc: np.ndarray, sub: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Union of spans, document by document."""
    order = np.lexsort((low, sub, doc))
    doc, sub, low, high = doc[order], sub[order], low[order].astype(np.int64), high[order].astype(np.int64)
    number = np.cumsum(_changes(doc, sub)) if len(doc) else low
    # The furthest end so far in the same document.
    reach = np.maximum.accumulate(number << 32 | high) & 0xFFFFFFFF if len(doc) else high
    new = _changes(doc, sub)
    new[1:] |= low[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(doc)] - 1 if len(begin) else begin
    return [doc[begin], sub[begin], low[begin].astype(np.int32), reach[end].astype(np.int32)]


def _spans(batches):
    """Spans of a bucket's windows that are not the first of their kind, and those that ride along."""
    value, tag, doc, sub, place, *riding = _whole(batches, _WINDOW + _SPAN)
    order = multikey_order([value, tag, doc, sub, place])
    again = order[_later(_changes(value[order], tag[order]), doc[order], sub[order], place[order])]
    out = [np.concatenate([a, b]) for a, b in zip(_runs(doc[again], sub[again], place[again]), riding)]
    for k in range(0, len(out[0]), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 18)]) for c in out], ["doc", "sub", "start", "end"])


def _splitters(texts: DataFrame, buckets: int) -> np.ndarray:
    def sampled(batches):
        for rows in _grouped(batches, SLICE_BYTES):
            for some in _blocks(rows):
                block = Block([r[1] for r in some])
                text, _, lead, _ = block.suffixes()
                kept = [lead[text == k] for k in range(len(some))]
                kept = np.concatenate([v[:: -(-len(v) // SAMPLE_EACH)] for v in kept if len(v)])
                yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64))], ["lead"])

    few = texts.orderBy(F.xxhash64("doc", "sub"), "doc", "sub").limit(SAMPLE_TEXTS)
    leads = few.mapInArrow(sampled, "lead long").toArrow().column(0).to_numpy().view(np.uint64)
    if not len(leads):
        return np.zeros(0, np.uint64)
    return np.sort(leads)[len(leads) * np.arange(1, buckets) // buckets]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc (the id; the least number for null), sub, start and end of spans to remove; spans may overlap."""
    spark = docs.sparkSession
    texts = _texts(docs)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    splitters = _splitters(texts, buckets)

    def suffixes(batches):
        for rows in _grouped(batches, REDUCED_BYTES):
            parts = []
            for some in _blocks(rows):
                text, place, lead, around = Block([r[1] for r in some]).suffixes()
                doc, sub = (np.array([r[k] for r in some], np.int64)[text] for k in (0, 2))
                parts.append((lead, around, doc, sub, place))
            columns = _joined(parts, (np.uint64, np.uint64, np.int64, np.int64, np.int32))
            dealt, marks = _reduced_suffixes(*columns)
            bucket = np.searchsorted(splitters, dealt[0], side="right")
            yield _dealt(bucket, buckets, [dealt[0].view(np.int64), dealt[1].view(np.int64), *dealt[2:]], marks)

    dealt = texts.mapInArrow(
        suffixes,
        "c0 int, c1 array<long>, c2 array<long>, c3 array<long>, c4 array<long>, c5 array<int>,"
        " c6 array<long>, c7 array<long>, c8 array<int>, c9 array<tinyint>",
    )
    marks = dealt.repartitionById(buckets, "c0").mapInArrow(_marked, "doc long, sub long, place int, mark tinyint")
    # As many marks as the text has anchors, at most.
    marks = marks.groupBy("doc", "sub").agg(F.collect_list("place").alias("places"), F.collect_list("mark").alias("marks"))
    marks = marks.withColumnsRenamed({"doc": "o_doc", "sub": "o_sub"})
    met = texts.join(marks.hint("shuffle_hash"), _same()).select("doc", "text", "sub", "places", "marks")

    def windows(batches):
        for rows in _grouped(batches, REDUCED_BYTES):
            parts, sure = [], []
            for some in _blocks(rows):
                block = Block([r[1] for r in some])
                text, place, value, tag = block.windows(*_places(block, some))
                doc, sub = (np.array([r[k] for r in some], np.int64)[text] for k in (0, 2))
                parts.append((value, tag, doc, sub, place))
                for r in some:
                    at = np.array(r[3], np.int64)[np.array(r[4]) == _COVERED]
                    low, high = np.maximum(at - REACH, 0), np.minimum(at + LENGTH, len(r[1]))
                    sure.append((np.full(len(at), r[0]), np.full(len(at), r[2]), low, high))
            value, tag, doc, sub, place = _joined(parts, (np.uint64, np.int32, np.int64, np.int64, np.int32))
            order = multikey_order([value, tag, doc, sub, place])
            new = _changes(value[order], tag[order])
            first, again = order[new], order[_later(new, doc[order], sub[order], place[order])]
            sure = _merged(*_joined([*sure, _runs(doc[again], sub[again], place[again])], _SPAN))
            bucket = ((value[first] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            columns = [value[first].view(np.int64), *(c[first] for c in (tag, doc, sub, place))]
            yield _dealt(bucket.astype(np.int64), buckets, columns, sure)

    compared = met.mapInArrow(
        windows,
        "c0 int, c1 array<long>, c2 array<int>, c3 array<long>, c4 array<long>, c5 array<int>,"
        " c6 array<long>, c7 array<long>, c8 array<int>, c9 array<int>",
    )
    return compared.repartitionById(buckets, "c0").mapInArrow(_spans, "doc long, sub long, start int, end int")


def _places(block: Block, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Covered and open places of the block."""
    places = np.concatenate([np.array(r[3], np.int64) + s for r, s in zip(rows, block.starts.tolist())])
    marks = np.concatenate([np.array(r[4], np.int8) for r in rows])
    return places[marks == _COVERED], places[marks == _OPEN]


def _same() -> Column:
    """Rows of the same document, named o_doc and o_sub on the other side."""
    return (F.col("doc") == F.col("o_doc")) & (F.col("sub") == F.col("o_sub"))


def _texts(docs: DataFrame) -> DataFrame:
    """doc, text and sub; what has them stays as it is."""
    if docs.columns == ["doc", "text", "sub"]:
        return docs
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    rows = with_keys(rows, F.col("text"), repeated_ids(docs))
    return rows.select(F.col("key.id").alias("doc"), "text", F.col("key.a").alias("sub"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document."""
    texts = _texts(docs)
    spans = repeated_spans(texts).groupBy("doc", "sub").agg(F.collect_list("start").alias("low"), F.collect_list("end").alias("high"))
    spans = spans.withColumnsRenamed({"doc": "o_doc", "sub": "o_sub"})
    met = texts.join(spans.hint("shuffle_hash"), _same(), "left").select("doc", "text", "low", "high")

    def kept(batches):
        for rows in _grouped(batches, SLICE_BYTES):
            out: list[list] = [[], [], [], [], []]
            for doc, text, low, high in rows:
                removed, spans_of, rest = _cut(text, low, high)
                made = (None if doc == _LAST else doc, len(text), removed, spans_of, rest)
                for column, v in zip(out, made):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return met.mapInArrow(kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _cut(text: bytes, low, high) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    if not low:
        return 0, 0, text
    depth = np.zeros(len(text) + 1, np.int64)
    np.add.at(depth, np.array(low), 1)
    np.add.at(depth, np.array(high), -1)
    gone = np.cumsum(depth[:-1]) > 0
    starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), starts, np.frombuffer(text, np.uint8)[~gone].tobytes()

