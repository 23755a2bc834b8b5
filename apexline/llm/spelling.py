"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A word is a point: how often each letter occurs in it. One inserted or deleted letter moves a point by a distance
(L1) of exactly one, one replaced letter by exactly two, so near words lie in small balls. Words are searched per
pair of lengths, (L, L) with radius two and (L, L + 1) with radius one.

The tree has two levels. A top tree per length, fitted on a bounded sample of the vocabulary (`SAMPLE` words; every
word is indexed, whatever the sample), cuts the space into regions of about `REGION` words; a word is a point of the
one region that holds it and a question to every region whose box its ball reaches. Inside a region a task builds a
k-d tree over the distinct vectors with tight boxes, prunes by box distance, and verifies the letter order of the
words behind each pair of vectors. A region with more than `LIMIT` points or questions, for instance many words of the
same letters, is dealt into a grid of tasks: each block of points meets each block of questions. Nothing is left out.

A task answers each question with a count and the best partner, so pairs are never shuffled.

Defined cases: null and empty texts have no words; a missing doc_id counts as the empty text in the hash; repeated
rows count each time; a run that loses a letter and is then too short is no word; a word without near words has
n_near 0; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.session import cut

SHORTEST = 6
OFTEN = 5
RATIO = 5
EDITED = 199
SAMPLE = 65_536
REGION = 8_192
LIMIT = 65_536
LEAF = 32
# Bytes of words that a task counts together before it hands them on, and pairs that it verifies together.
HELD_BYTES = 1 << 25
TOGETHER = 1 << 21

# Letters of a run stay, A-Z become a-z, all else becomes a blank.
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)
# Dimension of a letter's count.
_PLACE = np.array([c - 97 if 97 <= c <= 122 else c - 39 if 65 <= c <= 90 else 52 + c % 64 for c in range(256)], np.int32)
DIMENSIONS = 26 + 26 + 64


def runs_of(text: str) -> list[bytes]:
    """The runs of letters, lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def words_of(doc_id: int | None, text: str, shortest: int = SHORTEST) -> Iterator[tuple[str, int]]:
    """Words of a text and their numbers; every EDITED-th run of a document, by hash, has lost a letter."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in Counter(runs_of(text)).items():
        if len(run) < shortest:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % EDITED == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
            if len(run) < shortest:
                continue
        yield run, n


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, often: int = OFTEN) -> DataFrame:
    """word, n of the words with at least `often` occurrences in all documents together."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counter(), 0

        def out():
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_py() or "", shortest):
                    if word not in held:
                        size += len(word) + 100
                    held[word] += n
                if size > HELD_BYTES:
                    yield out()
                    held, size = Counter(), 0
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return total.filter(F.col("n") >= often)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of letters."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    return flat.reshape(len(words), -1) if words else np.empty((0, 0), np.uint8)


def _counts(codes: np.ndarray) -> np.ndarray:
    """Letter-count vectors."""
    n, length = codes.shape
    at = (np.arange(n)[:, None] * DIMENSIONS + _PLACE[codes]).ravel()
    kind = np.int16 if length < 1 << 14 else np.int32
    return np.bincount(at, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(kind)


def _split(points: np.ndarray) -> tuple[int, int] | None:
    """The widest dimension and a value: up to it left, beyond it right; None if all points are equal."""
    low, high = points.min(axis=0), points.max(axis=0)
    if not (high > low).any():
        return None
    k = int(np.where(high > low, points.var(axis=0), -1).argmax())
    middle = int(np.partition(points[:, k], (len(points) - 1) // 2)[(len(points) - 1) // 2])
    return k, min(middle, int(high[k]) - 1)


class Regions:
    """The top tree of one length: which region holds a vector, and which ones a ball reaches."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.count = 0
        self.root = self._grow(sample, parts)

    def _grow(self, points: np.ndarray, parts: int):
        cut_at = _split(points) if parts > 1 and len(points) > 1 else None
        if cut_at is None:
            self.count += 1
            return self.count - 1
        k, value = cut_at
        left = points[:, k] <= value
        return k, value, self._grow(points[left], parts // 2), self._grow(points[~left], parts - parts // 2)

    def reached(self, vectors: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(region, rows within the radius of its box)."""
        open_ = [(self.root, np.arange(len(vectors)), {}, {})]
        while open_:
            node, rows, low, high = open_.pop()
            far = np.zeros(len(rows), np.int32)
            for k, v in low.items():
                far += np.maximum(v - vectors[rows, k], 0)
            for k, v in high.items():
                far += np.maximum(vectors[rows, k] - v, 0)
            rows = rows[far <= radius]
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            k, value, left, right = node
            open_ += [(left, rows, low, high | {k: value}), (right, rows, low | {k: value + 1}, high)]


def near_vectors(points: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asked row, point row) at a distance of exactly `radius`, by a k-d tree over the points."""
    used = np.flatnonzero(points.any(axis=0) | asked.any(axis=0))
    points, asked = points[:, used], asked[:, used]
    if points.max(initial=0) < 128 and asked.max(initial=0) < 128:
        points, asked = points.astype(np.int8), asked.astype(np.int8)
    open_ = [(np.arange(len(points)), np.arange(len(asked)))]
    while open_:
        mine, who = open_.pop()
        box = points[mine]
        q = asked[who]
        far = np.maximum(box.min(axis=0) - q, 0).sum(axis=1, dtype=np.int32)
        far += np.maximum(q - box.max(axis=0), 0).sum(axis=1, dtype=np.int32)
        who = who[far <= radius]
        if not len(who):
            continue
        cut_at = _split(box) if len(mine) > LEAF else None
        if cut_at is None:
            step = max(1, TOGETHER // max(1, box.size))
            for k in range(0, len(who), step):
                some = who[k : k + step]
                apart = np.abs(asked[some][:, None, :] - box[None]).sum(axis=2, dtype=np.int32)
                a, b = np.nonzero(apart == radius)
                if len(a):
                    yield some[a], mine[b]
            continue
        left = box[:, cut_at[0]] <= cut_at[1]
        open_ += [(mine[left], who), (mine[~left], who)]


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by one replaced letter, or by one inserted into the shorter."""
    size = short.shape[1]
    if long.shape[1] == size:
        return (short != long).sum(axis=1) == 1
    front = np.logical_and.accumulate(short == long[:, :size], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= size


def near_words(points: list[str], asked: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asked, point) one edit apart; all points have one length, the asked words the same or one less."""
    if not points or not asked:
        return
    p, q = _codes(points), _codes(asked)
    radius = 2 if p.shape[1] == q.shape[1] else 1

    def classes(codes):
        """Distinct vectors, and the words of each: first place and number in an order."""
        vectors, of, sizes = np.unique(_counts(codes), axis=0, return_inverse=True, return_counts=True)
        return vectors, np.argsort(of.ravel(), kind="stable"), np.cumsum(sizes) - sizes, sizes

    pv, p_order, p_first, p_size = classes(p)
    qv, q_order, q_first, q_size = classes(q)
    together = max(1, TOGETHER // p.shape[1])
    for a, b in near_vectors(pv, qv, radius):
        pairs = q_size[a] * p_size[b]
        ends = np.cumsum(pairs)
        for k in range(0, int(ends[-1]), together):
            at = np.arange(k, min(k + together, int(ends[-1])))
            of = np.searchsorted(ends, at, side="right")
            inner = at - (ends[of] - pairs[of])
            x = q_order[q_first[a[of]] + inner // p_size[b[of]]]
            y = p_order[p_first[b[of]] + inner % p_size[b[of]]]
            true = _one_edit(q[x], p[y])
            if true.any():
                yield x[true], y[true]


def _regions(words: DataFrame, region: int) -> dict[int, Regions]:
    """Top trees of the lengths with more than one region's words."""
    many = words.groupBy(F.char_length("word").alias("length")).count().filter(F.col("count") > region).collect()
    parts = {r["length"]: -(-r["count"] // region) for r in many}
    if not parts:
        return {}
    own = F.xxhash64("word")
    # A share of the words first, so that no task sends a full sample to the driver.
    share = int(2**20 * min(1.0, 1.2 * SAMPLE / sum(r["count"] for r in many)))
    some = words.filter(F.char_length("word").isin(*parts) & (F.pmod(own, F.lit(1 << 20)) <= share))
    drawn = some.orderBy(own, "word").limit(SAMPLE)
    by_length: dict[int, list[str]] = {}
    for r in drawn.select("word").collect():
        by_length.setdefault(len(r["word"]), []).append(r["word"])
    return {
        # No finer than four sampled words a region.
        length: Regions(_counts(_codes(some)), min(parts[length], max(1, len(some) // 4)))
        for length, some in by_length.items()
    }


def _routed(words: DataFrame, trees: dict[int, Regions]) -> DataFrame:
    """length, region, role (0: a point, 1: asks with its own length, 2: one letter shorter), word, n."""
    held = words.sparkSession.sparkContext.broadcast(trees)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = pd.DataFrame({"word": batch.column(0).to_pylist(), "n": batch.column(1).to_numpy(zero_copy_only=False)})
            for length, part in frame.groupby(frame["word"].str.len(), sort=False):
                vectors = _counts(_codes(part["word"].tolist()))
                for role, target, radius in ((0, length, 0), (1, length, 2), (2, length + 1, 1)):
                    tree = held.value.get(target)
                    found = [(0, np.arange(len(part)))] if tree is None else tree.reached(vectors, radius)
                    for r, rows in found:
                        some = part.iloc[rows]
                        head = [np.full(len(some), v, np.int32) for v in (target, r, role)]
                        yield pa.RecordBatch.from_arrays(
                            [*map(pa.array, head), pa.array(some["word"].tolist(), pa.string()), pa.array(some["n"].to_numpy())],
                            ["length", "region", "role", "word", "n"],
                        )

    return words.select("word", "n").mapInArrow(routed, "length int, region int, role int, word string, n long")


def _dealt(routed: DataFrame, limit: int) -> DataFrame:
    """Rows with the task they go to: a region's own, or a place in its grid of blocks."""
    place = ["length", "region"]
    many = routed.groupBy(*place).agg(
        F.count_if(F.col("role") == 0).alias("n_points"), F.count_if(F.col("role") > 0).alias("n_asked")
    )
    wide = many.filter((F.col("n_points") > limit) | (F.col("n_asked") > limit)).select(
        *place, F.ceil(F.col("n_points") / limit).alias("p"), F.ceil(F.col("n_asked") / limit).alias("q")
    )
    dealt = routed.join(wide, place, "left").withColumns(
        {"p": F.greatest(F.coalesce("p", F.lit(1)), F.lit(1)), "q": F.greatest(F.coalesce("q", F.lit(1)), F.lit(1))}
    )
    own = F.xxhash64("word")
    a = F.when(F.col("role") == 0, F.array(F.pmod(own, F.col("p")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("p") - 1))
    b = F.when(F.col("role") > 0, F.array(F.pmod(own, F.col("q")))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("q") - 1))
    return dealt.withColumn("a", F.explode(a)).withColumn("b", F.explode(b)).drop("p", "q")


def _answers(frame: pd.DataFrame) -> pd.DataFrame:
    """Of each word of a task: how many near words it has here, and the best of them."""
    points = frame[frame["role"] == 0]
    out = []

    def told(words, partners, who, with_):
        seen = pd.DataFrame({"word": words["word"].to_numpy()[who], "near": partners["word"].to_numpy()[with_], "n": partners["n"].to_numpy()[with_]})
        seen = seen.sort_values(["n", "near"], ascending=[False, True]).groupby("word", sort=False)
        out.append(pd.DataFrame({"n_near": seen.size(), "form": seen["near"].first(), "form_n": seen["n"].first()}).reset_index())

    for role in (1, 2):
        asked = frame[frame["role"] == role]
        for who, with_ in near_words(points["word"].tolist(), asked["word"].tolist()):
            told(asked, points, who, with_)
            if role == 2:
                told(points, asked, with_, who)
    if not out:
        kinds = {"word": object, "n_near": "int64", "form": object, "form_n": "int64"}
        return pd.DataFrame({name: pd.Series([], dtype=kind) for name, kind in kinds.items()})
    # One row a word, whatever the number of leaves it met.
    seen = pd.concat(out).sort_values(["form_n", "form"], ascending=[False, True]).groupby("word", sort=False)
    first = seen.first()
    return first.assign(n_near=seen["n_near"].sum()).reset_index()[["word", "n_near", "form", "form_n"]]


def variants(words: DataFrame, *, region: int = REGION, limit: int = LIMIT, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n; each word once)."""
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    trees = _regions(words, region)
    dealt = _dealt(_routed(words, trees), limit)
    # Few bytes hold much work here, so the number of tasks goes by the regions.
    place = ["length", "region", "a", "b"]
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(t.count for t in trees.values()))
    found = dealt.repartition(tasks, *place).groupBy(*place).applyInPandas(
        _answers, "word string, n_near long, form string, form_n long"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    met = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    judged = words.join(met, "word", "left")
    good = -F.col("best.m") >= F.col("n") * ratio
    forms = cut(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"),
    ))
    # A form is `ratio` times as frequent as its word, so chains are short, and each step doubles the reach.
    steps = cut(forms.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not steps.filter("moved").isEmpty():
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = cut(steps.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        ))
    rooted = forms.join(steps.select("word", "root"), "word", "left")
    return rooted.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
