"""Toxicity: a noisy channel undoes disguised spelling, then the restored text is scored.

Disguise has three forms: signs that look like letters (1d10t), separators between single letters (i d i o t), and
repeated letters (idiiiot). A suspicious piece of text becomes a lattice: each character may stand for itself or for
one of the letters it resembles, a separator may be nothing, a repetition may be nothing, each at a cost. The Viterbi
path under a character language model is the restored spelling; the path on which nothing changes always competes.

The language model is an interpolated trigram model of letters and word ends. Its counts are gathered over all
documents, whatever their number; their table is bounded by the alphabet.

The score is a logistic regression on the words of the restored text and the openings of words (4 to 6 letters), each
present or not. It is fitted on a bounded sample: at most `sample` labelled rows of each label, chosen by a hash of the
id. Candidates are counted in Spark; the `TERMS` of them that tell the labels apart best become the terms.

Defined cases: null and empty texts, and texts without a known term, get the share that the model gives to a text
without evidence; label rows with nulls, or of ids without a document, teach nothing; repeated rows are scored alike;
without labels of both kinds every score is the share of label 1 (0 without labels); an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.llm.common import slices, whole_text

SAMPLE = 4_000
TERMS = 2_048
OPENINGS = (4, 5, 6)
THRESHOLD = 0.3
# A term must be in this many sampled rows, and tell the labels apart this well (likelihood ratio).
FEWEST = 5
SURENESS = 12.0
RIDGE = 0.02
# Units of text whose restored terms a worker remembers, of at most UNIT characters each.
HELD = 400_000
UNIT = 48

# Letters that a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e",
}
# Costs of the channel, as negative logarithms.
ALIKE, SIGN, EDGE, MASKED, JOINED, APART, DROPPED, THIRD = 1.0, 5.0, 2.5, 4.0, 0.3, 3.0, 0.7, 2.5

# Letters of the model: word end, a-z, Latin-1 small letters from 0xDF, and all other letters dealt into 32.
_SYMBOLS = 1 + 26 + 33 + 32


def _symbol(c: int) -> int:
    if 97 <= c <= 122:
        return c - 96
    if 0xDF <= c <= 0xFF and c != 0xF7:
        return 27 + c - 0xDF
    return 60 + c % 32 if c > 0xFF and chr(c).isalpha() else 0


_TABLE = np.array([_symbol(c) for c in range(1 << 16)], np.int32)


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.where(codes < 1 << 16, codes, 0)]


def trigram_counts(texts: list[str]) -> np.ndarray:
    """How often each triple of symbols occurs; runs of what is no letter are one word end."""
    s = symbols("\n" + "\n".join(texts) + "\n")
    s = s[np.append(True, (s[1:] > 0) | (s[:-1] > 0))]
    s = np.concatenate([[0], s, [0]])
    at = (s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:]
    return np.bincount(at, minlength=_SYMBOLS**3)


class Model:
    """Costs of letters after two others: interpolated trigrams."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape((_SYMBOLS,) * 3).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        flat = (one + 1) / (one.sum() + _SYMBOLS)

        def mixed(n, below):
            # The more kinds of followers, the more weight for the shorter context.
            kinds = (n > 0).sum(axis=-1, keepdims=True) + 1
            return (n + kinds * below) / (n.sum(axis=-1, keepdims=True) + kinds)

        self.costs = -np.log(mixed(three, mixed(two, flat))).astype(np.float32)


class Channel:
    """Restores disguised spelling."""

    _SIGNS = "".join(re.escape(c) for c in LOOKALIKES if not c.isdigit())
    _PIECE = re.compile(rf"(?:[^\W_]|[{_SIGNS}*])+")
    _DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}\d*]+[^\W\d_]|^[{_SIGNS}\d]+[^\W\d_]{{3}}|[^\W\d_]{{2}}\d+$|([^\W\d_])\1\1|([^\W\d_])\2.*([^\W\d_])\3")
    SPACED = re.compile(r"(?<![^\W_])[^\W_](?:([ .\-_])[^\W_]){1}(?:\1{1,3}[^\W_]){2,}(?![^\W_])")
    _ALL = [chr(c) for c in range(97, 123)]

    def __init__(self, model: Model):
        self.costs = model.costs

    def _edges(self, c: str, before: str) -> list[tuple[str, float]]:
        """What a character may stand for ('' for nothing), with costs."""
        if c in LOOKALIKES:
            return [(c, SIGN), *[(x, ALIKE) for x in LOOKALIKES[c]]]
        if c == "*":
            return [(c, SIGN), *[(x, MASKED) for x in self._ALL]]
        return [(c, 0.0), ("", DROPPED)] if c == before else [(c, 0.0)]

    def decode(self, piece: str, spaced: bool = False) -> str:
        """The cheapest reading of a piece. Of separators a reading drops any, of repeated letters all but one or two."""
        text = piece.lower()
        if len(text) != len(piece):
            piece = text
        # State: the last two symbols. Value: cost and the chain of letters so far.
        states = {(0, 0): (0.0, None)}
        before, run = "", 1
        for c in [*text, ""]:
            if not c:
                edges = [(" ", 0.0)]
            elif spaced and c in " .-_":
                # Two separators in a row are a gap between words.
                edges = [(c, 0.0 if before == " " else APART), ("", JOINED)]
                before = " "
            else:
                edges = self._edges(c, before)
                run = run + 1 if c == before else 1
                if run > 2 and len(edges) == 2:
                    edges = [(c, THIRD), edges[1]]
                before = c
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, chain) in states.items():
                for letter, price in edges:
                    if not letter:
                        key, total = (a, b), cost + price
                    else:
                        s = int(_TABLE[ord(letter)]) if ord(letter) < 1 << 16 else 0
                        # A run of ends is one.
                        same = s == 0 == b
                        own = EDGE * (letter in LOOKALIKES) if same else float(self.costs[a, b, s])
                        key, total = (a, b) if same else (b, s), cost + price + own
                    if key not in after or total < after[key][0]:
                        after[key] = (total, chain if not letter else (letter, chain))
            states = after
        _, chain = min(states.values(), key=lambda x: x[0])
        letters = []
        chain = chain[1]
        while chain is not None:
            letters.append(chain[0])
            chain = chain[1]
        found = "".join(reversed(letters))
        return piece if found == text else found

    def restore_unit(self, unit: str) -> str:
        """A text without blanks; only what looks disguised is decoded."""
        out, end = [], 0
        for m in self._PIECE.finditer(unit):
            core = m[0].lstrip("*+(|").rstrip("*+(|!$@€")
            if core and self._DISGUISED.search(core):
                begin = m.start() + m[0].index(core)
                out += [unit[end:begin], self.decode(core)]
                end = begin + len(core)
        return "".join([*out, unit[end:]]) if out else unit

    def join_spaced(self, text: str) -> str:
        """Single letters with separators between them, read as words."""
        return self.SPACED.sub(lambda m: self.decode(m[0], spaced=True), text)

    def restore(self, text: str) -> str:
        return re.sub(r"\S+", lambda m: self.restore_unit(m[0]), self.join_spaced(text))


# Bytes that are no letters become blanks.
_WORDS = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(unit: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in unit.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()]


def terms_of(unit: str) -> Iterator[str]:
    """Words of a restored unit, and openings of longer ones (with a mark)."""
    for w in words_of(unit):
        if len(w) <= UNIT:
            yield w
        for k in OPENINGS:
            if len(w) > k:
                yield w[:k] + "-"


class Reader:
    """The terms of texts, by a bounded memory of units; `known` maps terms to numbers, others are left out."""

    def __init__(self, channel: Channel, known: dict[str, int] | None):
        self.channel, self.known, self.memory = channel, known, {}
        self.most = HELD if known else HELD // 8

    def _unit(self, unit: str) -> tuple:
        found = terms_of(self.channel.restore_unit(unit))
        if self.known is None:
            return tuple(found)
        return tuple(self.known[t] for t in found if t in self.known)

    def read(self, text: str) -> set:
        out, memory = set(), self.memory
        for unit in set(self.channel.join_spaced(text).split()):
            found = memory.get(unit)
            if found is None:
                found = self._unit(unit)
                if len(unit) <= UNIT:
                    if len(memory) >= self.most:
                        memory.clear()
                    memory[unit] = found
            out.update(found)
        return out


def _texts(batches) -> Iterator[tuple[list, list[str]]]:
    for ids, texts in slices(batches):
        yield ids, [t.decode("utf-8", "replace") for t in texts]


def language_model(docs: DataFrame) -> Model:
    """Counts over the whole texts of all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for _, texts in _texts(batches):
            total += trigram_counts(texts)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            some = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["k", "n"])

    rows = docs.select(F.lit(None).cast("long").alias("id"), whole_text().alias("text"))
    # At most one row for each triple of the alphabet.
    told = rows.mapInArrow(counted, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SYMBOLS**3)
    counts[told["k"].to_numpy()] = told["n"].to_numpy()
    return Model(counts)


class Judge:
    """Language model, terms and their weights."""

    def __init__(self, model: Model, terms: list[str], weights: np.ndarray, bias: float):
        self.model, self.terms, self.weights, self.bias = model, terms, weights, bias

    def score(self, found: set[int]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(sum(self.weights[k] for k in found))))))


def _telling(rows: list, ones: int, zeros: int) -> list[str]:
    """Terms by how well they tell label 1, best first."""
    every = ones + zeros
    ranked = []
    for r in rows:
        a, b = r["a"], r["b"]
        g = 0.0
        for seen, size in ((a, ones), (b, zeros)):
            for k in (seen, size - seen):
                share = (a + b if k == seen else every - a - b) * size / every
                g += 2 * k * math.log(k / share) if k and share else 0.0
        ranked.append((-g, r["term"]))
    return [t for g, t in sorted(ranked) if -g >= SURENESS][:TERMS]


def _fitted(rows: list[np.ndarray], y: np.ndarray, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Logistic regression with ridge by Newton steps on the terms; samples weigh as common as their label is."""
    x = np.zeros((len(rows), width + 1), np.float32)
    x[:, width] = 1
    for k, found in enumerate(rows):
        x[k, found] = 1
    share = y.mean()
    weigh = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) / len(y)
    w = np.zeros(width + 1)
    keep = np.full(width + 1, RIDGE / len(y) * 10)
    keep[width] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weigh * (p - y)) + keep * w
        curve, force = np.diag(keep), (weigh * np.maximum(p * (1 - p), 1e-6)).astype(np.float32)
        for k in range(0, len(x), 1024):
            some = x[k : k + 1024]
            curve += (some * force[k : k + 1024, None]).T @ some
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:width], float(w[width])


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE) -> Judge:
    """Fit on at most `sample` rows per label of (doc_id, label); the language model on all documents."""
    spark = docs.sparkSession
    model = language_model(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter("doc_id is not null and y in (0, 1)")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    flat = Judge(model, [], np.zeros(0), math.log(max(prior, 1e-12) / max(1 - prior, 1e-12)))
    if len(counts) < 2:
        return flat
    order = F.xxhash64("doc_id")
    drawn = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(sample) for y in (0, 1)]
    # At most 2 * sample small rows are sent to every executor.
    chosen = F.broadcast(drawn[0].union(drawn[1]))
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).join(chosen, "doc_id")
    rows = rows.select("y", "text")
    held = spark.sparkContext.broadcast(model)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(Channel(held.value), None), (Counter(), Counter())

        def out():
            terms = list(seen[0] | seen[1])
            each = [pa.array([c[t] for t in terms], pa.int64()) for c in (seen[1], seen[0])]
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *each], ["term", "a", "b"])

        for ys, texts in _texts(batches):
            for y, text in zip(ys, texts):
                seen[y].update(reader.read(text))
            if len(seen[0]) + len(seen[1]) > HELD:
                yield out()
                seen = (Counter(), Counter())
        yield out()

    told = rows.mapInArrow(candidates, "term string, a long, b long")
    told = told.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter(F.col("a") + F.col("b") >= FEWEST)
    # Those that speak for label 1 by a rough measure; the bound is on what comes to the driver.
    rough = F.col("a") / F.sqrt(F.col("a") + F.col("b"))
    taken = {y: min(n, sample) for y, n in counts.items()}
    lifted = told.filter(F.col("a") * taken[0] > 2 * F.col("b") * taken[1])
    terms = _telling(lifted.orderBy(F.desc(rough), "term").limit(4 * TERMS).collect(), taken[1], taken[0])
    if not terms:
        return flat
    numbers = spark.sparkContext.broadcast({t: k for k, t in enumerate(terms)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Channel(held.value), numbers.value)
        for ys, texts in _texts(batches):
            found = [np.array(sorted(reader.read(t)), np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(found, pa.binary())], ["y", "terms"])

    # An id may have several documents; the bound holds all the same.
    got = rows.mapInArrow(read, "y int, terms binary").orderBy(F.xxhash64("terms"), "y").limit(4 * sample).collect()
    y = np.array([r["y"] for r in got], float)
    if len({*y.tolist()}) < 2:
        return flat
    weights, bias = _fitted([np.frombuffer(r["terms"], np.int32) for r in got], y, len(terms), prior)
    return Judge(model, terms, weights, bias)


def score(docs: DataFrame, judge: Judge, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(judge)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = held.value
        reader = Reader(Channel(j.model), {t: k for k, t in enumerate(j.terms)})
        for ids, texts in _texts(batches):
            values = [round(j.score(reader.read(t)), 6) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(scored, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def restored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text and the restored text of every document; null stays null."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel = Channel(held.value)
        for batch in batches:
            texts = [None if t is None else channel.restore(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "text", "restored"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(rewritten, "doc_id long, text string, restored string")
