"""Whitening of embeddings along their leading principal components.

Each entry c of a vector becomes the whole number x = floor(1024 c) + 100000. Partition iterators take the vectors one by one and update
their number, mean and sum of centred products by Welford's rank-one step; sums of x are kept exactly beside them. The parts merge by the parallel
formula, level by level in tasks, so that the driver takes a handful of matrices however many partitions there are. A symmetric QR iteration gives
the components; a second pass measures how far the covariance of the whitened values is from the identity.

Cases: vectors that are null or hold null, NaN or infinite entries give no rows. A fit needs one length: vectors of another length than the most frequent one
(of equally frequent ones the longest) give no rows and do not count in n. Entries beyond 2**62 / 1024 in size are taken as that. Repeated vectors and
repeated or null ids count as often as they stand. Components without variance (a single vector, equal vectors) have whitened and explained 0 and stay out of
identity_error, which is 0 if no component has variance. A deviation beyond 64 bits is null. Columns beside vec_id and embedding
are not read, whatever their names; an empty table, or one without usable vectors, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of an entry: units in one, and what is added, so that x is positive for common embeddings.
SCALE, SHIFT = 1024, 100_000
#: Components that are returned at most.
COMPONENTS = 8
#: Tasks that merge parts at most, level by level.
LEVELS = (64, 8)
_LIMIT = 2**62
PARTS = "part int, n bigint, sums array<decimal(38,0)>, mean array<double>, products array<double>"
_ARROW = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])


class Moments:
    """Number, exact sums, mean and sum of centred products of vectors; vectors are added one by one, and moments merge."""

    def __init__(self, size: int) -> None:
        self.n, self.sums = 0, [0] * size
        self.mean, self.products, self._step = np.zeros(size), np.zeros((size, size)), np.empty((size, size))

    def add(self, block: np.ndarray) -> None:
        """Welford's step for each row of a block of floats."""
        for x in block:
            self.n += 1
            away = x - self.mean
            self.mean += away / self.n
            np.multiply.outer(away, away * ((self.n - 1) / self.n), out=self._step)
            self.products += self._step

    def count(self, whole: np.ndarray) -> None:
        """Add a block of whole numbers to the exact sums."""
        if len(whole):
            exact = whole if int(np.abs(whole).max()) * len(whole) < _LIMIT else whole.astype(object)
            self.sums = [a + int(b) for a, b in zip(self.sums, exact.sum(axis=0), strict=True)]

    def merge(self, other: Moments) -> None:
        if other.n:
            n, apart = self.n + other.n, other.mean - self.mean
            self.products += other.products + np.multiply.outer(apart, apart * (self.n * other.n / n))
            self.mean += apart * (other.n / n)
            self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def batch(self, part: int) -> pa.RecordBatch:
        values = [[part], [self.n], [[Decimal(s) for s in self.sums]], [self.mean], [self.products.ravel()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _ARROW, strict=True)], schema=_ARROW)

    @staticmethod
    def of(n: int, sums: list, mean: list, products: list) -> Moments:
        out = Moments(len(mean))
        out.n, out.sums, out.mean = n, [int(s) for s in sums], np.array(mean)
        out.products = np.array(products).reshape(len(mean), len(mean))
        return out


def _merged(parts: Iterable[Moments], size: int) -> Moments:
    whole = Moments(size)
    for one in parts:
        whole.merge(one)
    return whole


def moments(rows: DataFrame, size: int, blocks: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]]) -> Moments:
    """Of all rows: ``blocks`` turns a batch into floats for the products and whole numbers for the sums."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(size)
        for batch in batches:
            floats, whole = blocks(batch)
            own.add(floats)
            if whole is not None:
                own.count(whole)
        if own.n:
            yield own.batch(TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _merged((Moments.of(r["n"], r["sums"], r["mean"], r["products"]) for b in batches for r in b.to_pylist()), size)
        if own.n:
            yield own.batch(TaskContext.get().partitionId())

    parts = rows.mapInArrow(collect, PARTS)
    for level in LEVELS:
        parts = parts.repartition(F.pmod("part", F.lit(level))).sortWithinPartitions("part").mapInArrow(merge, PARTS)  # small parts come together
    return _merged((Moments.of(r.n, r.sums, r.mean, r.products) for r in sorted(parts.collect(), key=lambda r: r.part)), size)


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: Householder reflections to three diagonals, then implicit QR steps with Wilkinson's shift."""
    a, n = np.array(matrix, dtype=float), len(matrix)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if not v[1:].any():
            continue
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        h = np.eye(n - k - 1) - 2 * np.multiply.outer(v, v)
        a[k + 1 :, k:] = h @ a[k + 1 :, k:]
        a[k:, k + 1 :] = a[k:, k + 1 :] @ h
        q[:, k + 1 :] = q[:, k + 1 :] @ h
    d, e = np.diag(a).copy(), np.diag(a, -1).copy()
    high, left = n - 1, 60 * n
    while high > 0:
        if abs(e[high - 1]) <= np.finfo(float).eps * (abs(d[high - 1]) + abs(d[high])) or abs(e[high - 1]) < np.finfo(float).tiny:
            e[high - 1] = 0.0
            high -= 1
            continue
        low = high - 1
        while low > 0 and abs(e[low - 1]) > np.finfo(float).eps * (abs(d[low - 1]) + abs(d[low])):
            low -= 1
        if not left:
            raise ArithmeticError("the QR iteration did not converge")
        left -= 1
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            a1, b1, a2 = d[k], e[k], d[k + 1]
            d[k] = c * c * a1 - 2 * c * s * b1 + s * s * a2
            d[k + 1] = s * s * a1 + 2 * c * s * b1 + c * c * a2
            e[k] = c * s * (a1 - a2) + (c * c - s * s) * b1
            x = e[k]
            if k < high - 1:
                z = -s * e[k + 1]
                e[k + 1] *= c
            q[:, [k, k + 1]] = np.stack([c * q[:, k] - s * q[:, k + 1], s * q[:, k] + c * q[:, k + 1]], axis=1)
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Whitener:
    """What a fit gives: everything in it is as large as the components, whatever the number of vectors."""

    n: int
    sums: list[int]
    components: np.ndarray  # one in each column
    values: np.ndarray  # their eigenvalues; 0 where there is no variance
    trace: float

    def away(self, whole: np.ndarray) -> np.ndarray:
        """n x - S, exactly: 64-bit numbers, or Python's where those do not reach."""
        fits = max(self.n * int(np.abs(whole).max(initial=0)), *map(abs, self.sums), 0) < _LIMIT // 2
        return whole * self.n - np.array(self.sums, dtype=np.int64) if fits else whole.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whiten(self, away: np.ndarray) -> np.ndarray:
        scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1.0)), 0.0)
        return (away.astype(float) / self.n) @ self.components * scale

    @staticmethod
    def deviations(away: np.ndarray) -> list[int | None]:
        """Exact sums of squares; null beyond 64 bits."""
        most = max((abs(int(x)) for x in (away.min(initial=0), away.max(initial=0))), default=0)
        exact = away if most * most * max(away.shape[1], 1) < 2**63 else away.astype(object)
        return [x if x < 2**63 else None for x in map(int, (exact * exact).sum(axis=1))]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows whose vector is there and finite throughout."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & finite)


def common_length(rows: DataFrame) -> int:
    """The most frequent length, of equally frequent ones the longest; 0 without rows."""
    first = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    """x of each vector of a column, as 64-bit numbers."""
    units = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * SCALE)
    return np.clip(units, -_LIMIT, _LIMIT).astype(np.int64) + SHIFT


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitener | None:
    """Of all ``rows`` of :func:`usable` with ``size`` entries."""

    def blocks(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        whole = _numbers(batch.column(0), size)
        return (whole - SHIFT).astype(float), whole

    found = moments(rows.select("embedding"), size, blocks)
    if not found.n:
        return None
    covariance = found.products / found.n
    values, vectors = symmetric_qr(covariance)
    trace = float(np.trace(covariance))
    noise = np.finfo(float).eps * size * max(float(values[0]), 0.0)
    return Whitener(found.n, found.sums, vectors[:, :components], np.where(values > noise, values, 0.0)[:components], trace)


def identity_error(rows: DataFrame, model: Whitener, size: int) -> float:
    """The largest entry, in size, of the whitened values' covariance minus the identity; measured over all rows."""
    there = model.values > 0
    k = int(there.sum())
    if not k:
        return 0.0
    found = moments(rows.select("embedding"), k, lambda batch: (model.whiten(model.away(_numbers(batch.column(0), size)))[:, there], None))
    return float(np.abs(found.products / found.n - np.eye(k)).max())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(embeddings)
    size = common_length(rows)
    rows = rows.where(F.size("embedding") == size)
    model = fit(rows, size, components) if size else None
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model, size)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(len(model.values))
    k, names = len(model.values), [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            away = model.away(_numbers(batch.column(1), size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(model.deviations(away), pa.int64()).take(each),
                    pa.array(model.whiten(away).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names,
            )

    return rows.mapInArrow(run, schema)
