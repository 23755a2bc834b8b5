"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made.

A text is cut where no vocabulary piece can reach across, each cut unit starts as one symbol per
character, and the adjacent pair whose joined piece ranks best is merged until none is left. The
count is the number of initial symbols less the merges. A character without a piece of its own
counts as its UTF-8 bytes.

Defined cases: null and empty texts have 0 tokens; whitespace counts like any text; equal texts
have equal counts; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.llm.common import slices, whole_text

SPACE = "▁"
# Units remembered per worker. A full memory starts anew, so it stays bounded.
REMEMBERED = 500_000


def merged_count(symbols: str, ranks: dict[str, float], weight) -> int:
    """Symbols left after merging; weight(character) is what an unmerged one counts."""
    n = len(symbols)
    if n == 1:
        return weight(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    part = list(symbols)
    heap = []

    def offer(i: int, j: int) -> None:
        joined = part[i] + part[j]
        rank = ranks.get(joined)
        if rank is not None:
            heap.append((rank, i, j, joined))

    for i in range(n - 1):
        offer(i, i + 1)
    heapq.heapify(heap)
    count = 0
    for c in symbols:
        count += weight(c)
    while heap:
        _, i, j, joined = heapq.heappop(heap)
        # The pair may have changed since it was offered.
        if part[i] is None or right[i] != j or part[i] + (part[j] or "") != joined:
            continue
        part[i], part[j] = joined, None
        after = right[j]
        right[i] = after
        count -= 1
        if after < n:
            left[after] = i
            rank = ranks.get(joined + part[after])
            if rank is not None:
                heapq.heappush(heap, (rank, i, after, joined + part[after]))
        before = left[i]
        if before >= 0:
            rank = ranks.get(part[before] + joined)
            if rank is not None:
                heapq.heappush(heap, (rank, before, i, part[before] + joined))
    return count


class Counter:
    """Counts tokens as the sentencepiece model at this path would."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        # A better score is merged first; equal scores go from left to right.
        self.ranks = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.single = {p for p in self.ranks if len(p) == 1}
        inner = {a + b for p in self.ranks for a, b in zip(p, p[1:])}
        # Units end before a space mark and where the kind of character changes, unless a piece
        # reaches across.
        crossing = {x for x in inner if x[1] == SPACE and x[0] != SPACE}
        crossing |= {x for x in inner if SPACE not in x and _kind(x[0]) != _kind(x[1])}
        self.crossing = re.compile("|".join(map(re.escape, sorted(crossing)))) if crossing else None
        self.unit = re.compile(rf"{SPACE}*(?:[^\W\d_]+|\d+|(?:[^\w{SPACE}]|_)+)|{SPACE}+")
        self.known: dict[str, int] = {}

    def _weight(self, c: str) -> int:
        return 1 if c in self.single else len(c.encode())

    def _unit(self, unit: str) -> int:
        n = self.known.get(unit)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[unit] = merged_count(unit, self.ranks, self._weight)
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = (SPACE + text).replace(" ", SPACE)
        if self.crossing is not None and self.crossing.search(marked):
            units = re.findall(rf"{SPACE}*[^{SPACE}]+|{SPACE}+", marked)
        else:
            units = self.unit.findall(marked)
        known = self.known.get
        counts = [known(u) for u in units]
        if None in counts:
            return sum(self._unit(u) if c is None else c for u, c in zip(units, counts))
        return sum(counts)


def _kind(c: str) -> int:
    return 0 if re.match(r"[^\W\d_]", c) else 1 if re.match(r"\d", c) else 2


# One counter per worker process and model, so that what it remembers serves later tasks too.
_COUNTERS: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, *, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every whole text.

    path: the sentencepiece model's file, readable on every executor.
    """

    def counted(batches):
        counter = counter_of(path)
        for ids, texts in slices(batches):
            n = [counter.count(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
