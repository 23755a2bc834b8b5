"""Benchmark decontamination by template windows.

Texts become sequences of tokens in which numbers, names (words with a leading capital) and units (a
unit word right after a number) are typed placeholders and every other word is itself in lower case.
Windows of WINDOW tokens of documents and benchmark items meet in an equality join on their hash. Windows
of one document and item at the same distance form an alignment. An alignment counts if it has LEAST
windows, or all of the item's, and its slots are consistent: each value of the item always stands for
the same value in the document, and the other way round. So questions asked anew with other numbers
and names are caught as well as copies.

A text in another case has other names. So there is a second sequence beside the typed one, in which names
are words like the others and only numbers and units are placeholders; both have their own windows and
alignments. An item of fewer than WINDOW tokens has no window and matches nothing, unless `short` is asked for:
then it is one window as a whole, with every token as it is but for the case; with fewer than SHORTEST tokens
it would be found nearly everywhere, and matches only a document of the same tokens.

Before the join a document's windows are looked up in a bit table of fixed size made from the
benchmark's hashes; windows that are not in it cannot join. The table's size does not depend on the
benchmark, so a large benchmark only sends more rows into the join.

Defined cases: null texts are empty; empty items and items without an id are left out; rows with another text
under one id, or without an id, are documents (or items) of their own, and a document is removed for its own
text only; repeated rows of one id and text are one; ties do not arise; extra columns are ignored; an empty
documents or benchmark table gives no pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apexline.llm.common import slices, whole_text

WINDOW = 8
# Matching windows an alignment needs: together they span thirteen tokens.
LEAST = 6
TABLE_BITS = 22
REMEMBERED = 400_000

# Words that are units when they follow a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs ounce ounces ton tons"
    " ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour"
    " hours day days week weeks month months year years percent dollar dollars euro euros cent cents"
    " pound pounds degree degrees watt watts volt volts kmh mph".split()
)
# Shorter items match only documents that consist of them.
SHORTEST = 3
_TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*")
_NUMBER, _NAME, _UNIT = 1, 2, 3
# Sequences: with names as placeholders, with names as words, and short items as they are.
TYPED, FOLDED, SHORT, ALONE = 0, 1, 2, 3
# Longer tokens are not remembered, so the memory's bytes are bounded too.
LONGEST_KNOWN = 64
_POWERS = [
    np.cumprod(np.full(WINDOW, base, np.uint64))
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
]

KEY = "struct<given: boolean, id: bigint, a: bigint, b: bigint>"
WINDOW_SCHEMA = f"key {KEY}, sequence int, length int, position int, hash long, slots array<string>"
_KEY_TYPE = pa.struct([("given", pa.bool_()), ("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


class _Known(dict):
    """Numbers of tokens, with their hashes and kinds in arrays."""

    def __init__(self):
        self.size = 0
        # The token's hash in lower case and as a typed one.
        self.hashes = np.zeros((2, 4096), np.uint64)
        self.kinds = np.zeros(4096, np.uint8)

    def __missing__(self, token: str) -> int:
        from xxhash import xxh64_intdigest

        first, low = token[0], token.lower()
        plain = typed = xxh64_intdigest(low, 0)
        kind = 0
        if not first.isalpha():
            kind, typed = _NUMBER, xxh64_intdigest("", _NUMBER)
        elif first.isupper():
            kind, typed = _NAME, xxh64_intdigest("", _NAME)
        if low in UNITS:
            kind |= _MAY_BE_UNIT
        k = self.size
        if k == len(self.kinds):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)], axis=1)
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
        self.hashes[0, k], self.hashes[1, k], self.kinds[k] = plain, typed, kind
        self.size += 1
        if len(token) <= LONGEST_KNOWN:
            self[token] = k
        return k


class Templates:
    """Token hashes and kinds; remembers what it has seen, within a bound."""

    def __init__(self):
        self.known = _Known()

    def _read(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, their hashes as words and as typed ones, kinds, and where a unit may be."""
        if self.known.size >= REMEMBERED:
            self.known = _Known()
        known = self.known
        tokens = _TOKEN.findall(text)
        numbers = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        kinds = known.kinds[numbers]
        return tokens, known.hashes[0, numbers], known.hashes[1, numbers], kinds & 3, kinds >= _MAY_BE_UNIT

    def sequences(self, text: str) -> tuple[list[str], np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Tokens, their hashes as words, and of the typed and the folded sequence: kinds and hashes."""
        tokens, plain, typed, kinds, units = self._read(text)
        # A unit word is a unit only after a number.
        units[1:] &= kinds[:-1] == _NUMBER
        units[:1] = False
        numbers = kinds == _NUMBER
        folded = np.where(numbers, typed, plain)
        out = {}
        for name, hashes, shown in ((TYPED, typed, kinds), (FOLDED, folded, np.where(numbers, kinds, 0))):
            # In the typed sequence a capital makes a name, whatever the word.
            here = units & (shown == 0)
            out[name] = np.where(here, _UNIT, shown).astype(np.uint8), np.where(here, np.uint64(_UNIT), hashes)
        return tokens, plain, out

    def windows(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Tokens, their kinds, and a hash (uint64) of every window, of the typed sequence."""
        tokens, _, out = self.sequences(text)
        kinds, hashes = out[TYPED]
        return tokens, kinds, rolled(hashes, WINDOW, TYPED)


_MAY_BE_UNIT = 4
# One memory of tokens per worker process.
_TEMPLATES = Templates()


def rolled(hashes: np.ndarray, length: int, sequence: int) -> np.ndarray:
    """A hash of every window of so many tokens."""
    n = max(0, len(hashes) - length + 1)
    out = np.full(n, length if length < WINDOW else 0, np.uint64)
    for k in range(length):
        out += hashes[k : k + n] * _POWERS[sequence][k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def template_windows(rows: DataFrame, held=None, lengths: tuple[int, ...] | None = None) -> DataFrame:
    """key, sequence, length, position, hash and slot values of the windows of (key, text).

    held: a broadcast bit table; windows outside it are left out. lengths: those of short items; without
    them the rows are items, of which a short one is a window of its own.
    """

    def windows_of(text):
        tokens, plain, sequences = _TEMPLATES.sequences(text)
        n = len(tokens)
        for sequence, (kinds, hashes) in sequences.items():
            yield tokens, kinds, sequence, WINDOW, rolled(hashes, WINDOW, sequence)
        whole = (n,) if n < WINDOW else ()
        none = np.zeros(n, np.uint8)
        for length in whole if lengths is None else lengths:
            if length >= SHORTEST:
                yield tokens, none, SHORT, length, rolled(plain, length, SHORT)
            elif length == n > 0:
                yield tokens, none, ALONE, length, rolled(plain, length, ALONE)

    def found(batches):
        table = None if held is None else np.unpackbits(held.value)
        for keys, texts in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for key, text in zip(keys, texts):
                for tokens, kinds, sequence, length, hashes in windows_of(text.decode()):
                    at = np.arange(len(hashes)) if table is None else np.flatnonzero(table[_place(hashes)])
                    for k, h in zip(at.tolist(), hashes[at].view(np.int64).tolist()):
                        slots = [tokens[j] for j in range(k, k + length) if kinds[j]]
                        if sequence == FOLDED:
                            slots = [s.lower() for s in slots]
                        for column, value in zip(out, (key, sequence, length, k, h, slots)):
                            column.append(value)
            types = (_KEY_TYPE, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            names = ["key", "sequence", "length", "position", "hash", "slots"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return rows.mapInArrow(found, WINDOW_SCHEMA)


def bit_table(windows: DataFrame) -> np.ndarray:
    """Packed bits, set where a window's hash lies; at most 2 ** TABLE_BITS numbers are collected."""
    place = F.shiftrightunsigned("hash", 64 - TABLE_BITS).cast("int")
    places = windows.select(place.alias("place")).distinct().toArrow().column(0).to_numpy()
    table = np.zeros(1 << TABLE_BITS, np.uint8)
    table[places] = 1
    return np.packbits(table)


def _key(name: str) -> Column:
    """Id and 128 bits of the text's hash."""
    text, told = whole_text(), F.col(name).cast("long")
    return F.struct(
        told.isNotNull().alias("given"), F.coalesce(told, F.lit(0).cast("long")).alias("id"),
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"),
    )


def _found(docs: DataFrame, benchmark: DataFrame, short: bool) -> DataFrame:
    """key (of the document), item_id, windows, exact: the alignments that count."""
    items = benchmark.filter("item_id is not null").select(_key("item_id").alias("key"), whole_text().alias("text"))
    items = template_windows(items).filter((F.col("length") == WINDOW) | F.lit(short))
    held = docs.sparkSession.sparkContext.broadcast(bit_table(items))
    # At most WINDOW - 1 numbers.
    below = items.filter(F.col("length") < WINDOW).select("length").distinct()
    lengths = tuple(sorted(r.length for r in below.collect()))
    texts = docs.select(_key("doc_id").alias("key"), whole_text().alias("text"))
    found = template_windows(texts, held, lengths)
    sizes = items.groupBy("key", "sequence").agg(F.countDistinct("position").alias("size"))
    items = items.join(sizes, ["key", "sequence"]).select(
        F.col("key").alias("item"), "sequence", "length", F.col("position").alias("at"), "hash",
        F.col("slots").alias("asked"), "size",
    )
    met = found.join(items, ["hash", "sequence", "length"]).select(
        "key",
        "item",
        "sequence",
        "size",
        (F.col("position") - F.col("at")).alias("apart"),
        "at",
        F.arrays_zip(F.col("asked").alias("a"), F.col("slots").alias("d")).alias("slots"),
        (F.col("asked") == F.col("slots")).alias("same"),
    )
    # An alignment has at most one row per window of the item.
    aligned = met.groupBy("key", "item", "sequence", "apart", "size").agg(
        F.countDistinct("at").alias("windows"),
        F.count_distinct(F.when(F.col("same"), F.col("at"))).alias("equal"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    pairs = F.size("slots")
    one_to_one = (F.size(F.array_distinct("slots.a")) == pairs) & (F.size(F.array_distinct("slots.d")) == pairs)
    enough = F.least(F.lit(LEAST), F.col("size"))
    kept = aligned.filter(((F.col("windows") >= enough) & one_to_one) | (F.col("equal") >= enough))
    # Other names leave holes in the folded sequence, so there only the whole item is its own.
    whole = (F.col("sequence") == TYPED) | (F.col("windows") == F.col("size"))
    return kept.select(
        "key", F.col("item.id").alias("item_id"), "windows",
        ((F.col("equal") == F.col("windows")) & whole).alias("exact"),
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """doc_id, item_id, n_windows (most in one alignment) and exact (its slots are the item's own)."""
    doc = F.when(F.col("key.given"), F.col("key.id")).alias("doc_id")
    return _found(docs, benchmark, short).groupBy(doc, "item_id").agg(
        F.max("windows").alias("n_windows"), F.max("exact").alias("exact")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """The documents without those that hold a benchmark item."""
    found = _found(docs, benchmark, short).select(F.col("key").alias("other")).distinct()
    rows = docs.select(_key("doc_id").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(found, F.col("key") == F.col("other"), "left_anti").select("row.*")
