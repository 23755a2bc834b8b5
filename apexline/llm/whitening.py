"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries become whole numbers x = floor(256 * c). The fit list holds every distinct x-vector once; it is stored as
packed blocks of rows in the shared folder, so a pass reads bytes and multiplies, nothing else. A pass computes the
covariance's product with a narrow block, V Q = (1/n) sum of (x - S/n) ((x - S/n) . Q), as one Spark job whose
partial sums meet in Spark; no vector and no covariance of all pairs of dimensions comes to the driver.

The filter is a Chebyshev polynomial over the unwanted part of the spectrum, from zero to the smallest Ritz value of
the block: the recurrence needs one pass a degree, keeps that part within one and lets the rest grow. QR and a
Rayleigh-Ritz step follow, and filters go on until the residual of every wanted component is at the level of
rounding (`TOLERANCE` of the largest eigenvalue), or no longer falls.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are rows of
another length than the commonest (the smaller one of two equally common); repeated rows, and rows with a null
vec_id, are returned as often as they are there; no component is given along which the fit list does not vary, so
equal vectors, a single row and an empty table give no rows; fewer dimensions than components give as many as there
are; deviation is null where it does not fit a long. Entries beyond 2^53 count as that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexline.functions.session import cut

COMPONENTS = 4
# Columns of the block beyond the wanted ones: the nearer the spectrum's values, the more these help.
GUARD = 20
DEGREE = 10
ROUNDS = 60
TOLERANCE = 1e-14
# A component with less than this share of the trace is rounding, no direction.
FLAT = 1e-12
BLOCK_ROWS = 4096
# Bytes of the fit list that one task of a pass reads, and partial sums that one task adds up.
TASK_BYTES = 1 << 23
SUMS = 1 << 20
LARGEST = float(1 << 53)


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id and x (array of long) of the rows that take part."""
    entry = F.col(f"`{column}`")
    fine = entry.isNotNull() & (F.size(entry) > 0) & F.forall(
        entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    x = F.transform(
        entry, lambda c: F.floor(F.greatest(F.least(c.cast("double") * 256, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long")
    )
    kept = rows.filter(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_column}`").cast("long").alias("id"), x.alias("x"))
    lengths = kept.groupBy(F.size("x").alias("n_dims")).count()
    common = lengths.orderBy(F.desc("count"), "n_dims").limit(1).collect()
    return kept.filter(F.size("x") == common[0]["n_dims"]) if common else kept.limit(0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def fit_list(vectors: DataFrame) -> DataFrame:
    """The distinct x-vectors as blocks: n rows of d whole numbers, packed."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = _matrix(batch.column(0).slice(k, BLOCK_ROWS))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(part)], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], ["n", "x"]
                )

    return cut(vectors.select("x").distinct().mapInArrow(packed, "n int, x binary"))


def _pass(blocks: DataFrame, tasks: int, made, size: int) -> np.ndarray:
    """Sum over all blocks of made(x), a flat array of `size` doubles."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for n, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += made(np.frombuffer(x, "<i8").reshape(n, -1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["k", "v"])

    out = np.zeros(size)
    # A task has summed what it read; the sums of all tasks meet in as few partitions as hold them with ease.
    meet = 1 + tasks * size // SUMS
    told = blocks.mapInArrow(partial, "k int, v double").repartition(meet, "k").groupBy("k").agg(F.sum("v").alias("v"))
    # At most `size` rows come back, however many tasks there are.
    for r in told.collect():
        out[r["k"]] = r["v"]
    return out


class Whitening:
    """n, exact sums per dimension, and the components with their eigenvalues (falling)."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray, trace: float, residual: float):
        self.n, self.sums, self.values, self.axes = n, sums, values, axes
        self.trace, self.residual = trace, residual
        self.mean = np.array([s // n + (s % n) / n for s in sums]) if n else np.zeros(0)
        self.identity_error = 0.0


def _filtered(product, block: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The block under the Chebyshev polynomial that stays small on [low, high], scaled at `top`."""
    half, middle = (high - low) / 2, (high + low) / 2
    scale = half / (top - middle)
    first = scale
    before, now = block, (product(block) - middle * block) * (scale / half)
    for _ in range(2, degree + 1):
        after = 1 / (2 / first - scale)
        before, now = now, 2 * (after / half) * (product(now) - middle * now) - scale * after * before
        scale = after
    return now


def learn(
    vectors: DataFrame, *, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS
) -> Whitening | None:
    """Fit on the distinct vectors; None if nothing varies."""
    blocks = fit_list(vectors)
    heads = blocks.agg(
        F.sum("n").alias("n"), F.max(F.expr("length(x) div (8 * n)")).alias("d"), F.sum(F.length("x")).alias("bytes")
    ).first()
    if not heads["n"]:
        return None
    n, d = int(heads["n"]), int(heads["d"])
    # Every pass reads all blocks, so their number of tasks goes by their size, not by the shuffle before them.
    tasks = 1 + int(heads["bytes"]) // TASK_BYTES
    blocks = blocks.coalesce(tasks)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            for rows, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Halves of 32 bits keep the sums of a block exact.
                m = np.frombuffer(x, "<i8").reshape(rows, -1)
                high, low = (m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)
                total = [t + (int(h) << 32) + int(b) for t, h, b in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(map(str, total))], ["k", "s"])

    told = blocks.mapInArrow(summed, "k int, s string").repartition(1 + tasks * d // SUMS, "k")
    told = told.groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = {r["k"]: int(r["s"]) for r in told.collect()}
    sums = [found[k] for k in range(d)]
    mean = np.array([s // n + (s % n) / n for s in sums])

    trace = float(_pass(blocks, tasks, lambda x: ((x - mean) ** 2).sum(axis=0), d).sum()) / n
    if not trace > 0:
        return None
    width = min(d, components + guard)

    def product(q: np.ndarray) -> np.ndarray:
        q = np.ascontiguousarray(q)
        wide = q.shape[1]

        def made(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return _pass(blocks, tasks, made, d * wide).reshape(d, wide) / n

    wanted = min(components, d)
    block, _ = np.linalg.qr(np.random.default_rng(42).normal(size=(d, width)))
    best, stuck, least = None, 0, np.inf
    for _ in range(rounds):
        image = product(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        residual = np.linalg.norm(image - block * values, axis=0)[:wanted].max() / max(values[0], 1e-300)
        if residual < least * 0.5:
            stuck = 0
        else:
            stuck += 1
        if residual < least:
            least, best = residual, (values[:wanted].copy(), block[:, :wanted].copy())
        # Certified, or rounding is all that is left.
        if least <= TOLERANCE or stuck >= 3 or width == d and least <= 1e-13:
            break
        cut_at, top = max(values[-1], 0.0), values[0]
        if width == d or not top > cut_at > 0:
            block, _ = np.linalg.qr(image)
            continue
        block, _ = np.linalg.qr(_filtered(product, block, degree, 0.0, cut_at, top))
    values, axes = best
    real = values > FLAT * trace
    if not real.any():
        return None
    model = Whitening(n, sums, values[real], axes[:, real] / np.linalg.norm(axes[:, real], axis=0), trace, float(least))
    k = int(real.sum())
    weights = model.axes / np.sqrt(model.values)

    def shadow(x: np.ndarray) -> np.ndarray:
        p = (x - mean) @ weights
        return np.concatenate([(p.T @ p).ravel(), p.sum(axis=0)])

    told = _pass(blocks, tasks, shadow, k * k + k)
    middle = told[k * k :] / n
    spread = told[: k * k].reshape(k, k) / n - np.outer(middle, middle)
    model.identity_error = float(np.abs(spread - np.eye(k)).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 of each row, exact; None beyond a long."""
    reach = max(n * int(np.abs(x).max(initial=0)), 0) + max(map(abs, sums), default=0)
    if reach * reach * max(len(sums), 1) < 1 << 62:
        return ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact.tolist()]


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of every row of id and x."""
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            shown = ((x - m.mean) @ (m.axes / np.sqrt(m.values))).ravel()
            rows, ids = len(x), batch.column(0).to_pylist()
            far = _deviations(x, m.n, m.sums)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i in ids for _ in range(k)], pa.int64()),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, m.n)),
                    pa.array([v for v in far for _ in range(k)], pa.int64()),
                    pa.array(shown),
                    pa.array(np.tile(m.values / m.trace, rows)),
                    pa.array(np.full(rows * k, m.identity_error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select("id", "x").mapInArrow(projected, schema)
