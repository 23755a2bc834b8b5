"""Document quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words and pairs of neighbouring words, its grams of GRAM bytes (for scripts that set no blanks
between words), both hashed to a fixed number of columns, triples of byte classes (letters, capitals, digits,
blanks, marks, ...) and two repetition terms: a word equal to the one before, a line seen before. Term weights and a
truncated singular value decomposition are fitted on a bounded sample of labelled rows; the sample's latent
vectors are broadcast. Every document is compared with all of them by blocked cosine products, and the
labels of the nearest vote with their similarity.

The sample holds at most `sample` rows of each label, chosen by a hash of the id; votes are weighted
by how common each label is, so that the choice does not shift the score.

Defined cases: texts without bytes have no direction and get the share of label 1; null text counts as
empty; label rows with nulls, or of ids without a document, teach nothing; repeated rows are scored
alike; equal similarities go to the earlier sampled row; without labels every score is 0.5; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.llm.common import slices, whole_text

SAMPLE = 2048
DIMENSIONS = 48
# Steps of the iteration that finds the axes.
STEPS = 6
NEIGHBOURS = 25
# Similarities to this power weigh the votes.
SHARPNESS = 8
BLOCK = 512

_CLASSES = 9
# Columns of hashed words and pairs, and of hashed grams.
WORD_TERMS = GRAM_TERMS = 2048
GRAM = 5
_BLANKS = b" \t\n\r\x0b\x0c"


def _classes() -> np.ndarray:
    """Class of a byte; marks are one class but for the full stop and comma of ordinary sentences."""
    table = np.full(256, 6, np.uint16)
    table[:32] = 4
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[ord(" ")] = 3
    table[[ord("."), ord(",")]] = 5
    table[0x80:0xC0] = 7
    table[0xC0:] = 8
    return table


_TABLE = _classes()
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.isin(np.arange(256), np.frombuffer(_BLANKS, np.uint8))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHAPES = _CLASSES**3
_REPEATS = _SHAPES + WORD_TERMS + GRAM_TERMS
TERMS = _REPEATS + 2


def _column(hashes: np.ndarray, columns: int) -> np.ndarray:
    """Columns by the upper bits of hashes."""
    return ((hashes * _FACTOR) >> np.uint64(40)).astype(np.int64) % columns


def _word_hashes(low: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """One hash a word, in order: its bytes as digits of a number, from the left, modulo 2 ** 64."""
    inside = ~_BLANK[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    powers = np.cumprod(np.full(int(length.max()), _FACTOR))
    at = np.flatnonzero(inside)
    place = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    return np.add.reduceat((low[at] + np.uint64(1)) * powers[place], np.cumsum(length) - length)


def term_counts(text: bytes) -> np.ndarray:
    """Share of each term in a text, as its square root; letters A-Z are lower-cased but for the classes."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    c, low = _TABLE[raw], _LOWER[raw]
    if len(c) >= 3:
        triples = c[:-2] * (_CLASSES * _CLASSES) + c[1:-1] * _CLASSES + c[2:]
        out[:_SHAPES] = np.bincount(triples, minlength=_SHAPES) / len(triples)
    words = _word_hashes(low, raw)
    if len(words):
        pairs = words[:-1] * np.uint64(3) + words[1:]
        columns = _column(np.concatenate((words, pairs)), WORD_TERMS)
        out[_SHAPES : _SHAPES + WORD_TERMS] = np.bincount(columns, minlength=WORD_TERMS) / len(columns)
        out[_REPEATS] = (words[1:] == words[:-1]).sum() / len(words)
    if len(low) >= GRAM:
        grams = np.zeros(len(low) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            grams = grams * np.uint64(257) + low[k : len(low) - GRAM + 1 + k]
        out[_SHAPES + WORD_TERMS : _REPEATS] = np.bincount(_column(grams, GRAM_TERMS), minlength=GRAM_TERMS) / len(grams)
    lines = text.split(b"\n")
    out[_REPEATS + 1] = 1 - len(set(lines)) / len(lines)
    return np.sqrt(out, out=out)


def leading_axes(rows: np.ndarray, count: int) -> np.ndarray:
    """The rows' leading right singular vectors, one a row, by subspace iteration from a fixed start."""
    width = min(count + 16, *rows.shape)
    basis = np.linalg.qr(rows.T @ np.random.default_rng(0).standard_normal((len(rows), width)).astype(np.float32))[0]
    for _ in range(STEPS):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    # Inside the subspace the decomposition is exact.
    turned = np.linalg.svd(rows @ basis, full_matrices=False)[2]
    return (turned @ basis.T)[:count]


class Space:
    """Latent vectors of labelled rows, and the way into their space."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, share: float):
        present = (terms > 0).sum(axis=0)
        self.weights = np.log((1 + len(terms)) / (1 + present)).astype(np.float32) + 1
        weighted = terms * self.weights
        axes = leading_axes(weighted, DIMENSIONS)
        # The sign of an axis is free; fix it so that equal samples give equal spaces.
        flip = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
        self.axes = (axes * flip[:, None]).T.astype(np.float32)
        self.share = share
        found = labels.mean() if len(labels) else share
        weight = np.where(labels == 1, share / max(found, 1e-9), (1 - share) / max(1 - found, 1e-9))
        self.votes = weight.astype(np.float32)
        self.labels = labels.astype(np.float32)
        self.vectors = self._unit(weighted @ self.axes)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(rows, axis=1, keepdims=True)
        return (rows / np.where(length > 0, length, 1)).astype(np.float32)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        rows = self._unit((terms * self.weights) @ self.axes)
        near = np.clip(rows @ self.vectors.T, 0, 1)
        k = min(NEIGHBOURS, near.shape[1])
        nearest = np.argpartition(-near, k - 1, axis=1)[:, :k]
        similar = np.take_along_axis(near, nearest, axis=1) ** SHARPNESS * self.votes[nearest]
        total = similar.sum(axis=1)
        up = (similar * self.labels[nearest]).sum(axis=1)
        return np.where(total > 0, up / np.where(total > 0, total, 1), self.share)


def _packed(terms: np.ndarray) -> bytes:
    """The terms that are there, with their columns."""
    at = np.flatnonzero(terms)
    return at.astype(np.uint16).tobytes() + terms[at].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    count = len(packed) // 6
    out = np.zeros(TERMS, np.float32)
    out[np.frombuffer(packed, np.uint16, count)] = np.frombuffer(packed[2 * count :], np.float32)
    return out


def _terms_of(texts: list[bytes]) -> np.ndarray:
    return np.stack([term_counts(t) for t in texts])


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> Space | None:
    """Fit the space on at most `sample` rows per label of (doc_id, label)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter("doc_id is not null and y in (0, 1)")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return None
    order = F.xxhash64("doc_id")
    parts = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(sample) for y in sorted(counts)]
    chosen = parts[0]
    for other in parts[1:]:
        chosen = chosen.union(other)

    def counted(batches):
        for batch in batches:
            labels_of = dict(enumerate(batch.column(2).to_pylist()))
            at = 0
            for ids, texts in slices([batch.select([0, 1])]):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([labels_of[at + k] for k in range(len(ids))], pa.int32()),
                        pa.array([_packed(term_counts(t)) for t in texts], pa.binary()),
                    ],
                    ["doc_id", "y", "terms"],
                )
                at += len(ids)

    # At most 2 * sample small rows are sent to every executor.
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    rows = rows.mapInArrow(counted, "doc_id long, y int, terms binary")
    # An id may have several documents; the bound holds all the same.
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "terms").limit(2 * sample).collect()
    if not found:
        return None
    terms = np.stack([_unpacked(r["terms"]) for r in found])
    return Space(terms, np.array([r["y"] for r in found]), counts.get(1, 0) / sum(counts.values()))


def score(docs: DataFrame, space: Space | None) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(space)

    def scored(batches):
        model = held.value
        for ids, texts in slices(batches):
            for k in range(0, len(ids), BLOCK):
                some = texts[k : k + BLOCK]
                values = np.full(len(some), 0.5) if model is None else model.scores(_terms_of(some))
                values = np.clip(np.round(values.astype(np.float64), 6), 0, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[k : k + BLOCK], pa.int64()), pa.array(values)], ["doc_id", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows = rows.mapInArrow(scored, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
