"""Embedding whitening by TSQR and a one-sided Jacobi SVD.

Entries become longs (64 steps to the unit, from 1,000,000), so that the distinct vectors, their number n and their sums S are exact, and
n * x - S is each row's exact n-fold distance from the mean. Blocks of these centred rows are compressed task by task to
one triangle R (QR of the last triangle above the next block); the triangles meet in groups of GROUP until at most
GROUP are left. Plane rotations then make R's columns orthogonal, pair by pair, until every pair is so to rounding:
their lengths are the standard deviations (times the root of n) with high relative accuracy even for the smallest, and
the accumulated rotations are the components. The covariance is never formed to find them.

Only triangles and sums reach the driver: numbers that grow with the dimension, not with the rows.

Defined cases: vectors that are null, hold nulls, infinities or NaN, or entries beyond +-2**34, are left out; if vectors
differ in length, those of the length that most distinct vectors have count (the shorter in a tie), others are left out.
A component whose deviation is zero to rounding can't be scaled and is left out, so of n equal vectors nothing is returned. Repeated vectors
are one in the fit and get equal rows; rows are whatever their ids, null ids included. A deviation that passes a
long is null. Other columns are left out. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import batch, drop, shared_dir, stored, tidied

SCALE, ORIGIN, MOST = 64, 1_000_000, float(1 << 40)
#: Rows of a block, triangles that meet in one task.
BLOCK, GROUP = 1024, 32
SWEEPS = 60


def steps(vector: Column) -> Column:
    """The vector as longs; null where it has no place in the fit."""
    wide = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < MOST, F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(F.when(F.coalesce(fits, F.lit(False)), wide), lambda x: x.cast("long") + ORIGIN))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def folded(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of r above rows."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(deviations, components as columns) of r's columns by plane rotations, from the greatest.

    A sweep rotates all pairs, d / 2 of them that share no column at once (each column meets each other once).
    """
    d = r.shape[1]
    w = np.array(r, float)
    v = np.eye(d)
    if d % 2:  # one more column of zeros: it never turns
        w, v = np.hstack([w, np.zeros((len(w), 1))]), np.vstack([np.hstack([v, np.zeros((d, 1))]), np.zeros((1, d + 1))])
    seats = np.arange(w.shape[1])
    half = len(seats) // 2
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            i, j = seats[:half], seats[half:][::-1]
            a, b = w[:, i], w[:, j]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            go = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if go.any():
                turned = True
                zeta = (beta[go] - alpha[go]) / (2 * gamma[go])
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                i, j = i[go], j[go]
                for m in (w, v):
                    m[:, i], m[:, j] = c * m[:, i] - s * m[:, j], s * m[:, i] + c * m[:, j]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    w, v = w[:, :d], v[:d, :d]
    size = np.sqrt((w * w).sum(0))
    order = np.argsort(-size, kind="stable")
    return size[order], v[:, order]


@dataclass
class Model:
    n: int
    sums: np.ndarray
    #: Eigenvalues of the covariance of those components that are kept, their directions as columns, and the trace.
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        return x * self.n - self.sums

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart.astype(float) / self.n) @ self.components / np.sqrt(self.values)


def triangle(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows of longs (one column x)."""
    d = len(sums)
    out = pa.schema([("k", pa.int32()), ("r", pa.binary())])
    packed = lambda k, r: batch(out, [[k], [np.ascontiguousarray(r).tobytes()]])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = None
        for b in batches:
            x = _matrix(b.column(0), d)
            for at in range(0, len(x), BLOCK):
                r = folded(r, (x[at : at + BLOCK] * n - sums).astype(float) / n)
        if r is not None:
            yield packed(TaskContext.get().partitionId(), r)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, r in zip(*(c.to_pylist() for c in b.columns)):
                held[k] = folded(held.get(k), np.frombuffer(r).reshape(-1, d))
        for k, r in held.items():
            yield packed(k, r)

    path = shared_dir(rows.sparkSession)
    level = 0
    of = stored(rows.mapInArrow(tidied(squeeze), "k int, r binary"), f"{path}/{level}", files=0)
    while (many := of.count()) > GROUP:
        level += 1
        groups = -(-many // GROUP)
        of = stored(of.select((F.col("k") % groups).alias("k"), "r").repartition(groups, "k").mapInArrow(tidied(meet), "k int, r binary"), f"{path}/{level}", files=0)
    r = None
    for row in sorted(of.collect()):
        r = folded(r, np.frombuffer(row["r"]).reshape(-1, d))
    drop(rows.sparkSession, path)
    return np.zeros((0, d)) if r is None else r


def _totals(rows: DataFrame) -> list:
    """Of each length of vectors: length, number, sums, as tasks add them up first."""
    out = pa.schema([("d", pa.int32()), ("n", pa.int64()), ("place", pa.int32()), ("total", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            sizes = b.column(0).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                x = _matrix(b.column(0).filter(pa.array(sizes == d)), d) if d else np.zeros((int((sizes == 0).sum()), 0), np.int64)
                n, s = held.get(d, (0, np.zeros(d, np.int64)))
                held[d] = n + len(x), s + x.sum(0)
        for d, (n, s) in held.items():
            yield batch(out, [[d] * (d + 1), [n, *[0] * d], [-1, *range(d)], [0, *s.tolist()]])

    return rows.mapInArrow(tidied(add), "d int, n long, place int, total long").groupBy("d", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()


def fit(distinct: DataFrame, components: int) -> Model:
    """From a stored table of distinct vectors of longs (one column x)."""
    totals = _totals(distinct)
    counts = {r["d"]: r["n"] for r in totals if r["place"] == -1}
    if not counts:
        return Model(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)
    d = min(counts, key=lambda k: (-counts[k], k))
    n, sums = counts[d], np.zeros(d, np.int64)
    for r in totals:
        if r["d"] == d and r["place"] >= 0:
            sums[r["place"]] = r["total"]
    rows = distinct.where(F.size("x") == d)
    size, turned = jacobi(triangle(rows, n, sums)) if d else (np.zeros(0), np.zeros((0, 0)))
    values = size * size / n
    kept = int((size[:components] > size[:1].max(initial=0.0) * max(d, 1) * 1e-14).sum())
    model = Model(n, sums, values[:kept], turned[:, :kept], float(values.sum()))
    model.identity_error = _identity_error(rows, model) if kept else 0.0
    return model


def _identity_error(rows: DataFrame, model: Model) -> float:
    """How far the whitened rows' covariance is from the identity; its mean is taken off first."""
    d, k = len(model.sums), len(model.values)
    out = pa.schema([("place", pa.int32()), ("total", pa.float64())])

    def total(of: np.ndarray, first: int) -> pa.RecordBatch:
        return batch(out, [pa.array(np.arange(first, first + of.size, dtype=np.int32)), pa.array(of.reshape(-1))])

    def summed(part, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros(size)
            for b in batches:
                s += part(model.whitened(model.apart(_matrix(b.column(0), d))))
            yield total(s, 0)

        got = np.zeros(size)
        for r in rows.mapInArrow(tidied(run), "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect():
            got[r["place"]] = r["total"]
        return got / model.n

    mean = summed(lambda z: z.sum(0), k)
    return float(np.abs(summed(lambda z: ((z - mean).T @ (z - mean)).reshape(-1), k * k).reshape(k, k) - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """A row for each vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    path = shared_dir(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), steps(F.col(f"`{vector_col}`")).alias("x")).where("x is not null")
    model = fit(stored(rows.select("x").distinct(), f"{path}/distinct"), components)
    drop(vectors.sparkSession, path)
    d, k = len(model.sums), len(model.values)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not k:
                continue
            apart = model.apart(_matrix(b.column(1), d))
            most = int(np.abs(apart).max(initial=0))
            if d * most * most < 1 << 63:
                far = pa.array((apart * apart).sum(1))
            else:  # numbers of any size
                far = pa.array([y if (y := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in apart.tolist()], pa.int64())
            m = b.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            yield batch(
                schema,
                [
                    b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), far.take(each),
                    pa.array(model.whitened(apart).reshape(-1)), pa.array(np.tile(model.values / model.trace, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
            )

    return rows.where(F.size("x") == d).mapInArrow(tidied(run), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
