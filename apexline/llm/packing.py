"""Packing of documents into token sequences by multiway differencing.

A document's ids are cut into windows of full capacity and a rest of smaller pieces. The pieces of a
shard (as many documents as fill SHARD_WINDOWS windows) are packed by Karmarkar-Karp differencing:
every piece starts as a partition of its own, the two partitions with the largest imbalance are merged
so that large sums meet small ones, until one partition with near-equal sums is left. When one of its
sums exceeds the capacity, the number of windows rises by one and the shard is packed anew.

A shard lies within one input partition, so nothing is shuffled and memory is bounded by a shard.

Defined cases: null and empty texts are the end id alone; repeated rows are packed once each; texts
longer than a window spread over several sequences; an empty table gives no rows; equal sums keep
input order; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.llm.common import slices, whole_text

CAPACITY = 4096
# Windows of one shard; pieces that take part in differencing are at most PIECE tokens long.
SHARD_WINDOWS = 128
PIECE = 512
# Tokens left free per window, so that sums that differ by a little still fit.
MARGIN = 8
REMEMBERED = 400_000

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
    " offset long"
)


def differenced(lengths: list[int], windows: int) -> tuple[list[int], list[list[int]]]:
    """Sums, largest first, and members of a partition into that many windows."""
    heap = [(-n, k, [n], [[k]]) for k, n in enumerate(lengths)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        # Sums not listed are zero: only as many must meet as exceed the windows.
        meet = max(0, len(a) + len(b) - windows)
        alone = len(a) - meet
        sums = a[:alone] + [x + y for x, y in zip(a[alone:], reversed(b))] + b[: len(b) - meet]
        groups = in_a[:alone] + [x + y for x, y in zip(in_a[alone:], reversed(in_b))] + in_b[: len(b) - meet]
        order = sorted(range(len(sums)), key=sums.__getitem__, reverse=True)
        sums, groups = [sums[k] for k in order], [groups[k] for k in order]
        least = sums[-1] if len(sums) == windows else 0
        heapq.heappush(heap, (least - sums[0], turn, sums, groups))
        turn += 1
    return (heap[0][2], heap[0][3]) if heap else ([], [])


def packed(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Members of each window; no sum exceeds the capacity."""
    windows = -(-sum(lengths) // capacity)
    while True:
        sums, groups = differenced(lengths, windows)
        if not sums or sums[0] <= capacity:
            return groups
        windows += 1


class Encoder:
    """Token ids, little-endian 32-bit, as the tokenizer file at this path gives them.

    Texts of plain letters, digits, marks and blanks go word by word through a memory of words; any
    other text goes to the library whole.
    """

    _UNUSUAL = re.compile(r"[^\x20-\x7e\n\t\r\xc0-\xd6\xd8-\xf6\xf8-\xff]")
    _WORD = re.compile(
        r"[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+"
    )

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        every = np.arange(self.library.get_vocab_size(with_added_tokens=True), dtype="<u4").tobytes()
        self.as_bytes = [every[k : k + 4] for k in range(0, len(every), 4)]
        self.known: dict[str, bytes] = {}
        # The model reads bytes as characters: printable Latin-1 as itself, the others from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}

    def _learn(self, word: str) -> bytes:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        as_bytes = word.encode().decode("latin-1").translate(self.shown)
        ids = b"".join([self.as_bytes[t.id] for t in self.model.tokenize(as_bytes)])
        self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self._UNUSUAL.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self._WORD.findall(text.lower())
        known = self.known.get
        parts = [known(w) for w in words]
        if None in parts:
            parts = [self._learn(w) if p is None else p for w, p in zip(words, parts)]
        return b"".join(parts)


# One encoder per worker process and file, so that what it remembers serves later tasks too.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Shards:
    """Collects pieces of documents; gives rows as shards fill up."""

    def __init__(self, part: int, capacity: int):
        self.capacity = capacity
        self.next_id = part << 36
        self.full = SHARD_WINDOWS * (capacity - MARGIN)
        self.rows: list[tuple] = []
        self.pieces: list[tuple] = []
        self.held = 0

    def _row(self, piece: tuple, sequence: int, offset: int) -> None:
        doc, start, ids, total = piece
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset))

    def add(self, doc, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            self._row((doc, start, ids[4 * start : 4 * (start + self.capacity)], total), self.next_id, 0)
            self.next_id += 1
        start = whole
        while start < total:
            n = min(PIECE, total - start, self.full - self.held)
            self.pieces.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            self.held += n
            start += n
            if self.held == self.full:
                self.close()

    def close(self) -> None:
        for members in packed([len(p[2]) // 4 for p in self.pieces], self.capacity):
            offset = 0
            for k in sorted(members):
                self._row(self.pieces[k], self.next_id, offset)
                offset += len(self.pieces[k][2]) // 4
            self.next_id += 1
        self.pieces, self.held = [], 0

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 7
        names = [c.split()[0] for c in SCHEMA.split(",")]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, path: str, *, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence.

    path: the tokenizers file, readable on every executor.
    """

    def pieces(batches):
        encoder = encoder_of(path)
        end = np.array([end_id], "<u4").tobytes()
        shards = _Shards(TaskContext.get().partitionId(), capacity)
        for ids, texts in slices(batches):
            for doc, text in zip(ids, texts):
                shards.add(doc, encoder.encode(text.decode()) + end)
            if shards.rows:
                yield shards.taken()
        shards.close()
        if shards.rows:
            yield shards.taken()

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(pieces, SCHEMA)
