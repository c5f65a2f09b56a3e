"""Embedding whitening: moments by rank-one updates in partitions, merged in pairs, and an eigen-solve by symmetric QR."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import packed, settled, ship

#: Parts whose moments one task merges; a component whose variance is at most this share of the trace has none.
FAN, NOTHING = 64, 1e-13


@dataclass
class Moments:
    """How many vectors, their mean and the sum of outer products of their deviations from it."""

    n: int
    mean: np.ndarray
    square: np.ndarray

    @classmethod
    def none(cls, d: int) -> Moments:
        return cls(0, np.zeros(d), np.zeros((d, d)))

    def add(self, rows: np.ndarray) -> None:
        """One row after the other: the deviation from the old mean times that from the new one is added."""
        outer = np.empty_like(self.square)
        for x in rows:
            self.n += 1
            before = x - self.mean
            self.mean = self.mean + before / self.n
            np.multiply.outer(before, x - self.mean, out=outer)
            self.square += outer

    def merge(self, other: Moments) -> None:
        """Of two disjoint parts: the squares add up, with that of the step between the means, weighed by n m / (n + m)."""
        if not other.n:
            return
        both, step = self.n + other.n, other.mean - self.mean
        self.square = self.square + other.square + np.multiply.outer(step, step) * (self.n * other.n / both)
        self.mean = self.mean + step * (other.n / both)
        self.n = both


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and q with a = q t q', by Householder reflections of a symmetric matrix."""
    a, n = a.astype(float).copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        if not np.any(x[1:]):
            continue
        x /= np.abs(x).max()  # else squares of what rounding leaves may underflow
        x[0] += math.copysign(np.linalg.norm(x), x[0])
        v = x / np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ a[k + 1 :, k]) * v
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns, by implicit QR steps with Wilkinson's shift.

    Each step turns the unreduced block at the end by rotations that chase one entry off the tridiagonal form; an
    off-diagonal entry that rounding can't tell from zero splits it.
    """
    n = len(a)
    d, e, q = tridiagonal(np.asarray(a, float))
    q, tiny = q.T.copy(), np.finfo(float).eps  # rows are eigenvectors, so that rotations touch whole rows
    least = tiny * tiny * max(np.abs(d).max(initial=0), np.abs(e).max(initial=0))
    high, steps = n - 1, 0
    while high > 0:
        small = np.abs(e) <= tiny * (np.abs(d[:-1]) + np.abs(d[1:])) + least
        e[small] = 0
        if e[high - 1] == 0:
            high, steps = high - 1, 0
            continue
        steps += 1
        if steps > 200:
            raise ArithmeticError("the eigen-solve doesn't converge")
        low = high - 1
        while low > 0 and e[low - 1] != 0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            q[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ q[[k, k + 1]]
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.int64)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of vectors in the batch: the length, which rows have it, and their vectors."""
    sizes = batch.column("d").to_numpy()
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        yield d, own, _matrix(batch.column("x").take(pa.array(own)), d)


_MOMENTS = "d int, part long, n long, mean array<double>, square array<double>, total array<long>"


def _told(found: dict[int, tuple[Moments, np.ndarray]], part: int) -> pa.RecordBatch:
    rows = sorted(found.items())
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
    values = [[d for d, _ in rows], [part] * len(rows), [m.n for _, (m, _) in rows], [m.mean for _, (m, _) in rows], [m.square.ravel() for _, (m, _) in rows], [t for _, (_, t) in rows]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _MOMENTS.split(", ")])


def _merged(table: pa.Table) -> tuple[Moments, np.ndarray]:
    d = table.column("d")[0].as_py()
    all_, total = Moments.none(d), np.zeros(d, np.int64)
    for n, mean, square, t in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "square", "total")), strict=True):
        all_.merge(Moments(n, np.array(mean, float), np.array(square, float).reshape(d, d)))
        total += np.array(t, np.int64)
    return all_, total


def moments(vectors: DataFrame) -> DataFrame:
    """d, n, mean, square, total (exact sums) of the vectors (d int, x array<long>) of each length.

    A task updates its moments row by row and hands on one row for each length; tasks of FAN parts each merge those,
    and one task for each length merges what is left. Its input is a row for every FAN partitions, not for vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, tuple[Moments, np.ndarray]] = {}
        for batch in batches:
            for d, _, x in _by_size(batch):
                all_, total = found.setdefault(d, (Moments.none(d), np.zeros(d, np.int64)))
                all_.add(x.astype(float))
                total += x.sum(axis=0)
        yield _told(found, TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        d, part = table.column("d")[0].as_py(), table.column("part")[0].as_py()
        return pa.Table.from_batches([_told({d: _merged(table)}, part // FAN)])

    ship(vectors.sparkSession)
    parts = vectors.select("d", "x").mapInArrow(run, _MOMENTS)
    few = parts.groupBy("d", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(merge, _MOMENTS)
    return few.groupBy("d").applyInArrow(merge, _MOMENTS)


def _projected(x: np.ndarray, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S) as exact numbers, and the whitened components; those without variance are NaN."""
    n, total, axes, values = model
    if n * float(np.abs(x).max(initial=0)) + float(np.abs(total).max(initial=0)) < 2.0**62:
        centred = n * x - total
    else:
        centred = n * x.astype(object) - total.astype(object)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1)), np.nan)
    return centred, (centred / n).astype(float) @ axes * scale


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and its first `most` components.

    Entries become x = floor(scale * c) + offset. The model is fitted on the distinct x: mean, covariance (divisor n,
    centred before multiplying) and its eigenvectors, numbered from 1 by falling eigenvalue e. `deviation` is the exact
    sum of (n x - S)^2, NULL where a long can't hold it; `whitened` is (x - S / n) along the eigenvector over sqrt(e);
    `explained` is e over the trace. `identity_error` is measured: the whitened distinct vectors are put
    through moments of their own, and it is how far their covariance is from the identity.

    Moments grow with the square of the vectors' length, not with rows; equal vectors meet after partial aggregation.
    The driver holds one model (a mean and `most` eigenvectors) for each length of vectors.

    Rows whose vector is null, or has a null, NaN or infinite entry, take no part, nor do those with an entry whose
    integer passes 2**52, which doubles can't tell from its neighbours; rows with a null id or a repeated one stay.
    Vectors of different lengths are whitened apart, empty ones give no rows. A component without variance (one vector
    alone, a constant entry) has NULL for whitened, and 0 explained. An empty table gives an empty result. Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    parts = F.col(vector_col).cast("array<double>")
    fit = F.size(parts) > 0
    fit &= F.forall(parts, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * scale < 2.0**52), F.lit(False)))
    x = F.transform(parts, lambda c: F.floor(c * scale).cast("long") + offset)
    base = vectors.where(F.col(vector_col).isNotNull()).where(fit).select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("d"), x.alias("x"))
    distinct = settled(base.select("d", "x").distinct())
    models = {}
    for r in moments(distinct).collect():  # a row for each length of vectors
        d, n = r["d"], r["n"]
        cov = np.array(r["square"]).reshape(d, d) / n
        values, axes = symmetric_qr((cov + cov.T) / 2)
        trace, keep = float(np.trace(cov)), min(most, d)
        values = np.where(values > NOTHING * trace, values, 0.0)[:keep]
        models[d] = (n, np.array(r["total"], np.int64), axes[:, :keep].copy(), values, values / trace if trace else values)
    shared = spark.sparkContext.broadcast(models)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, tuple[Moments, np.ndarray]] = {}
        for batch in batches:
            for d, _, v in _by_size(batch):
                w = np.nan_to_num(_projected(v, shared.value[d][:4])[1])
                found.setdefault(d, (Moments.none(w.shape[1]), np.zeros(w.shape[1], np.int64)))[0].add(w)
        yield _told(found, TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        d, part = table.column("d")[0].as_py(), table.column("part")[0].as_py()
        k = len(table.column("mean")[0])
        own = table.set_column(0, "d", pa.array([k] * table.num_rows, pa.int32()))
        return pa.Table.from_batches([_told({d: _merged(own)}, part // FAN)])

    squares = distinct.mapInArrow(measured, _MOMENTS).groupBy("d", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(merge, _MOMENTS).groupBy("d").applyInArrow(merge, _MOMENTS)
    errors = {}
    for r in squares.collect():
        k, have = len(r["mean"]), models[r["d"]][3] > 0
        off = np.abs(np.array(r["square"]).reshape(k, k) / r["n"] - np.eye(k))[np.ix_(have, have)]
        errors[r["d"]] = float(off.max(initial=0.0))
    error = max(errors.values(), default=0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, own, v in _by_size(batch):
                n, _, _, values, share = shared.value[d]
                centred, w = _projected(v, shared.value[d][:4])
                k = len(values)
                if centred.dtype != object and d * float(np.abs(centred).max(initial=0)) ** 2 < 2.0**62:
                    sums = np.einsum("ij,ij->i", centred, centred).tolist()
                else:
                    sums = [sum(int(c) * int(c) for c in row) for row in centred.tolist()]
                    sums = [s if s < 1 << 63 else None for s in sums]
                whole = w.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))), pa.array(np.full(len(own) * k, n, np.int64)),
                        pa.array([s for s in sums for _ in range(k)], pa.int64()), pa.array(whole, pa.float64(), mask=np.isnan(whole)), pa.array(np.tile(share, len(own))), pa.array(np.full(len(own) * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return base.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_welford_whitening(spark, sf_dir: str) -> DataFrame:
    return packed(whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
