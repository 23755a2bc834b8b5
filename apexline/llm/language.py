"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of `WINDOW` bytes. In each window one gated recurrent layer runs forwards
and one backwards; at every byte their states give a probability for each language. A document's
probabilities are the means over all its bytes. The network is trained in numpy by backpropagation
through time with Adam, on windows of a bounded sample of labelled texts. Gates and states use the
softsign x / (1 + |x|), which is cheaper than the exponential.

Defined cases: a text that is null or has no letter is `und` with score 0; ties go to the first
language in alphabetical order; rows with null text, language or id teach nothing; repeated rows are
labelled alike; extra columns are ignored; without any labelled text everything is `und`; an empty
table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.llm.common import slices, whole_text

UNKNOWN = "und"
WINDOW = 64
HIDDEN = 8
# Bounds of the training sample: languages, texts of each, windows of a text.
LANGUAGES = 200
TEXTS = 600
WINDOWS = 8
STEPS = 500
BATCH = 256
RATE = 0.02
# Windows that run through the network together.
TOGETHER = 2048


def _softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Two gated recurrent layers over byte windows, and a softmax at every byte.

    Arrays are laid out with windows along the last axis. Of a layer's 3 * HIDDEN rows the first third
    is the update gate, the second the reset gate, the last the candidate state.
    """

    def __init__(self, classes: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"] = draw.normal(0, 0.3, (3 * h, 256)).astype(np.float32)
            self.p[f"u{way}"] = draw.normal(0, 0.3, (3 * h, h)).astype(np.float32)
        self.p["o"] = draw.normal(0, 0.3, (classes, 2 * h)).astype(np.float32)
        self.p["c"] = np.zeros((classes, 1), np.float32)

    def _layer(self, windows: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States (steps, HIDDEN, windows); windows is (steps, windows)."""
        x, u, h = self.p[f"x{way}"], self.p[f"u{way}"], HIDDEN
        steps, n = windows.shape
        states = np.zeros((steps, h, n), np.float32)
        state = np.zeros((h, n), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            given = x[:, windows[t]]
            from_state = u @ state
            gates = _softsign(given[: 2 * h] + from_state[: 2 * h])
            gates += 1
            gates *= 0.5
            z, r = gates[:h], gates[h:]
            new = _softsign(given[2 * h :] + r * from_state[2 * h :])
            before, state = state, new + z * (state - new)
            states[t] = state
            if keep is not None:
                keep.append((t, before, z, r, new, from_state[2 * h :]))
        return states

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(steps, classes, windows); the layers again, but in buffers made once."""
        steps, n = windows.shape
        h = HIDDEN
        given, inner = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        spare, out = np.empty((2 * h, n), np.float32), np.empty((steps, len(self.p["o"]), n), np.float32)
        part = np.empty(out.shape[1:], np.float32)
        gates, new, recalled = given[: 2 * h], given[2 * h :], inner[2 * h :]
        places = windows.astype(np.intp)
        for k, way in enumerate("fb"):
            x, u, o = self.p[f"x{way}"], self.p[f"u{way}"], self.p["o"][:, k * h : (k + 1) * h].copy()
            state = np.zeros((h, n), np.float32)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                np.take(x, places[t], axis=1, out=given, mode="clip")
                np.matmul(u, state, out=inner)
                gates += inner[: 2 * h]
                np.abs(gates, out=spare)
                spare += 1
                gates /= spare
                gates += 1
                gates *= 0.5
                recalled *= gates[h:]
                new += recalled
                np.abs(new, out=recalled)
                recalled += 1
                new /= recalled
                state -= new
                state *= gates[:h]
                state += new
                if way == "f":
                    np.add(np.matmul(o, state, out=part), self.p["c"], out=out[t])
                else:
                    out[t] += np.matmul(o, state, out=part)
        return self._softmax(out)

    @staticmethod
    def _softmax(values: np.ndarray) -> np.ndarray:
        values -= values.max(axis=1, keepdims=True)
        np.exp(values, out=values)
        values /= values.sum(axis=1, keepdims=True)
        return values

    def gradients(self, windows: np.ndarray, labels: np.ndarray, seen: np.ndarray) -> dict:
        """Gradients of the mean cross-entropy over the bytes that are seen (steps, windows)."""
        tapes = {"f": [], "b": []}
        both = np.concatenate([self._layer(windows, w, tapes[w]) for w in "fb"], axis=1)
        error = self._softmax(self.p["o"] @ both + self.p["c"])
        error[:, labels, np.arange(windows.shape[1])] -= 1
        error *= (seen / max(1, seen.sum()))[:, None, :]
        grad = {
            "o": np.einsum("tcn,tin->ci", error, both),
            "c": error.sum(axis=(0, 2))[:, None],
        }
        down = np.einsum("ci,tcn->tin", self.p["o"], error)
        for k, way in enumerate("fb"):
            grad |= self._layer_gradients(windows, way, tapes[way], down[:, k * HIDDEN : (k + 1) * HIDDEN])
        return grad

    def _layer_gradients(self, windows, way, tape, down) -> dict:
        u, h = self.p[f"u{way}"], HIDDEN
        to_x, to_u = np.zeros((256, 3 * h), np.float32), np.zeros_like(u)
        carried = np.zeros((h, windows.shape[1]), np.float32)
        for t, before, z, r, new, inner in reversed(tape):
            d = down[t] + carried
            # Through softsign: its slope is (1 - |value|)^2; a gate's is half of that, of 2 * gate - 1.
            to_new = d * (1 - z) * (1 - np.abs(new)) ** 2
            to_z = d * (before - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            to_r = to_new * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            at_sum = np.concatenate([to_z, to_r, to_new])
            at_state = np.concatenate([to_z, to_r, to_new * r])
            np.add.at(to_x, windows[t], at_sum.T)
            to_u += at_state @ before.T
            carried = d * z + u.T @ at_state
        return {f"x{way}": to_x.T, f"u{way}": to_u}

    def train(self, windows: np.ndarray, seen: np.ndarray, labels: np.ndarray, seed: int = 7) -> None:
        """windows and seen are (windows, steps)."""
        draw = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        # Languages take part equally often, however many windows they have.
        groups = [np.flatnonzero(labels == k) for k in range(self.p["o"].shape[0])]
        for step in range(1, STEPS + 1):
            of = draw.integers(0, len(groups), BATCH)
            rows = np.array([groups[k][draw.integers(0, len(groups[k]))] for k in of])
            grad = self.gradients(windows[rows].T, labels[rows], seen[rows].T.astype(np.float32))
            rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
                self.p[k] -= (rate * move).astype(np.float32)


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of non-empty texts (windows, WINDOW), their lengths, and windows per text."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts])
    joined = b"".join([t + bytes(-len(t) % WINDOW) for t in texts])
    lengths = np.full(counts.sum(), WINDOW)
    lengths[np.cumsum(counts) - 1] = [(len(t) - 1) % WINDOW + 1 for t in texts]
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), lengths, counts


def pooled(network: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, classes): mean probabilities over the bytes of non-empty texts."""
    windows, lengths, counts = cut_windows(texts)
    sums = []
    for k in range(0, len(windows), TOGETHER):
        some, n = windows[k : k + TOGETHER], lengths[k : k + TOGETHER]
        seen = (np.arange(WINDOW)[:, None] < n).astype(np.float32)
        found = network.probabilities(np.ascontiguousarray(some.T))
        sums.append(np.einsum("tcn,tn->nc", found, seen))
    starts = np.cumsum(counts) - counts
    totals = np.add.reduceat(np.concatenate(sums).astype(np.float64), starts, axis=0)
    return totals / np.array([len(t) for t in texts])[:, None]


_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def learn(labelled: DataFrame) -> tuple[Network, list[str]] | None:
    """Train on (doc_id, text, lang); the sample's bounds are this module's constants."""
    rows = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    rows = rows.filter("doc_id is not null and text is not null and lang is not null and length(text) > 0")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    names = sorted(r["lang"] for r in counts)
    if not names:
        return None
    # A text takes part if its hash lies in its language's share; the hash order bounds the rest.
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, TEXTS / r["count"]))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def windows(batches):
        for batch in batches:
            langs = batch.column(2).to_pylist()
            at = 0
            for ids, texts in slices([batch.select([0, 1])]):
                found = []
                for doc, text, lang in zip(ids, texts, langs[at : at + len(ids)]):
                    draw = np.random.default_rng(abs(doc))
                    last = max(0, len(text) - WINDOW)
                    for start in sorted({int(s) for s in draw.integers(0, last + 1, WINDOWS)}):
                        found.append((doc, lang, text[start : start + WINDOW]))
                at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.string(), pa.binary()))],
                    ["doc_id", "lang", "bytes"],
                )

    chosen = rows.filter(drawn < share).mapInArrow(windows, "doc_id long, lang string, bytes binary")
    limit = 2 * len(names) * TEXTS * WINDOWS
    taken = chosen.orderBy(F.xxhash64("doc_id", "bytes"), "lang").limit(limit).collect()
    if not taken:
        return None
    names = sorted({r["lang"] for r in taken})
    texts = [bytes(r["bytes"]) for r in taken]
    windows_of = np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t in texts), np.uint8).reshape(-1, WINDOW)
    seen = np.arange(WINDOW) < np.array([len(t) for t in texts])[:, None]
    network = Network(len(names))
    network.train(windows_of, seen, np.array([names.index(r["lang"]) for r in taken]))
    return network, names


def _judged(model, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if model and has_letter(t.decode())]
    if known:
        network, langs = model
        found = pooled(network, [texts[k] for k in known])
        for k, best, value in zip(known, found.argmax(axis=1), found.max(axis=1)):
            names[k], scores[k] = langs[best], min(1.0, round(float(value), 6))
    return names, scores


def identify(docs: DataFrame, model: tuple[Network, list[str]] | None) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def identified(batches):
        for ids, texts in slices(batches):
            names, scores = _judged(held.value, texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names), pa.array(scores)],
                ["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return rows.mapInArrow(identified, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: tuple[Network, list[str]] | None, *, least: float) -> DataFrame:
    """The rows, all columns, whose text has a language with at least that score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def kept(batches):
        for batch in batches:
            places = pa.RecordBatch.from_arrays(
                [pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["place", "text"]
            )
            mask = []
            for _, texts in slices([places]):
                mask += [n != UNKNOWN and s >= least for n, s in zip(*_judged(held.value, texts))]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
