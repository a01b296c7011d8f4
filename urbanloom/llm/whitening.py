"""Whitening of embeddings by a tall-skinny QR and one-sided Jacobi rotations.

Vectors are taken in whole steps, x = floor(quantum * c), so that counts, sums and means are exact. The fit list has each
distinct x once. Tasks factor their blocks of centred rows and keep the triangle R; triangles are stacked and factored
again, FAN at a time, until one is left, whose columns have the lengths and angles of all centred rows' columns. Plane
rotations make the columns of R orthogonal to each other, pair by pair; the rotations taken together are the components,
the columns' lengths over the square root of n the standard deviations. The covariance is never formed, so small
deviations keep their digits.

Memory: a task holds BLOCK_VALUES values and FAN triangles; the driver holds one triangle, dimension squared.

Edge cases: rows are dropped whose vector is null or holds null, NaN or infinite entries; repeated rows count once in the
fit and each get a result; a component without deviation (within rounding) is left out, so vectors that are all equal, or
of no entries, give no components, and with them empty arrays; an empty table gives an empty result. Vectors of different
lengths raise ValueError. Only the id and the vector are read. A ``deviation`` beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanloom.llm.common import Scratch

#: Triangles that one step of the tree stacks.
FAN = 8
#: Values of one block of rows.
BLOCK_VALUES = 1 << 20
LONG = 2**63


@dataclass(frozen=True)
class Whitening:
    """Components are rows; n, sums and largest describe the fit list of whole steps x."""

    n: int
    sums: tuple[int, ...] = ()
    largest: int = 0
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    explained: list[float] = field(default_factory=list)
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        if 2 * self.n * self.largest < LONG:
            return (self.n * x - np.array(self.sums, np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """For each row the sum over dimensions of (n x - sum) squared, exactly."""
        if len(self.sums) * (2 * self.n * self.largest) ** 2 < LONG:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < LONG else None for v in exact]


def whole_steps(vector: Column, quantum: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(quantum))).cast("long"))


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def _matrix(column: pa.ListArray) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors have different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), int(sizes[0]) if len(sizes) else 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        x = _matrix(batch.column(0))
        step = max(1, BLOCK_VALUES // max(1, x.shape[1]))
        for k in range(0, len(x), step):
            yield x[k : k + step]


def _summed(parts: DataFrame, column: str) -> list:
    """Sums by place over the arrays of all tasks; one row for each place reaches the driver."""
    rows = parts.select(F.posexplode(column).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    return [r.value for r in sorted(rows)]


def _moments(fit: DataFrame, scratch: Scratch) -> Whitening:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest, sums = 0, 0, None
        for x in _blocks(batches):
            n, largest = n + len(x), max(largest, int(x.max(initial=0)), -int(x.min(initial=0)))
            if n * largest >= LONG:
                raise OverflowError("sums of the vectors' steps exceed 64 bits; take a smaller quantum")
            if sums is not None and len(sums) != x.shape[1]:
                raise ValueError("vectors have different lengths")
            sums = x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "largest": [largest], "sums": pa.array([sums.tolist()], pa.list_(pa.int64()))})

    parts = scratch.write(lambda: fit.mapInArrow(run, "n long, largest long, sums array<long>"))
    total = parts.agg(F.sum("n").alias("n"), F.max("largest").alias("largest"), F.min(F.size("sums")).alias("shortest"), F.max(F.size("sums")).alias("longest")).first()
    if total.shortest != total.longest:
        raise ValueError("vectors have different lengths")
    return Whitening(total.n or 0, tuple(_summed(parts, "sums")), total.largest or 0)


def _stacked(r: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")


def triangle(fit: DataFrame, model: Whitening, scratch: Scratch) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    d, schema = len(model.sums), "part long, r array<double>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for x in _blocks(batches):
            r = _stacked(r, model.centred(x))
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    def merged(table: pa.Table) -> pa.Table:
        r = None
        for part in table.column("r").to_pylist():
            r = _stacked(r, np.array(part).reshape(-1, d))
        return pa.table({"part": table.column("part").slice(0, 1), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    level = scratch.write(lambda: fit.mapInArrow(local, "r array<double>").withColumn("part", F.spark_partition_id().cast("long")))
    left = level.count()
    while left > 1:
        groups = -(-left // FAN)
        level = scratch.write(lambda level=level, groups=groups: level.withColumn("part", F.pmod(F.col("part"), F.lit(groups))).groupBy("part").applyInArrow(merged, schema))
        left = level.count()
    return np.array(level.first().r).reshape(-1, d)


def orthogonal_columns(r: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Jacobi: r @ v with orthogonal columns, and v. A step rotates disjoint pairs, as in a round of a tournament."""
    d = r.shape[1]
    u, v = r.astype(float).T.copy(), np.eye(d)  # rows are columns of r
    seats = np.arange(d + d % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            alpha, beta, gamma = (u[p] ** 2).sum(axis=1), (u[q] ** 2).sum(axis=1), (u[p] * u[q]).sum(axis=1)
            size = np.sqrt(alpha) * np.sqrt(beta)
            turn = np.abs(gamma) > tolerance * size
            if turn.any():
                worst = max(worst, float((np.abs(gamma[turn]) / size[turn]).max()))
                p, q, alpha, beta, gamma = (x[turn] for x in (p, q, alpha, beta, gamma))
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = (1 / np.hypot(1.0, t))[:, None]
                s = c * t[:, None]
                for m in (u, v):
                    m[p], m[q] = c * m[p] - s * m[q], s * m[p] + c * m[q]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 10 * tolerance:
            break
    return u.T, v.T


def _identity_error(fit: DataFrame, model: Whitening, scratch: Scratch) -> float:
    k = len(model.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for x in _blocks(batches):
            w = model.project(x)
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tolist()], pa.list_(pa.float64()))})

    total = np.array(_summed(fit.mapInArrow(run, "total array<double>"), "total")) / model.n
    covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])  # the rows are centred already; what is left is rounding
    return float(np.abs(covariance - np.eye(k)).max())


def fit_whitening(fit: DataFrame, components: int, scratch: Scratch) -> Whitening:
    """``fit``: a table of one column of whole steps, each vector once."""
    model = _moments(fit, scratch)
    d = len(model.sums)
    if not model.n or not d:
        return model
    turned, axes = orthogonal_columns(triangle(fit, model, scratch))
    lengths = np.sqrt((turned**2).sum(axis=0))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > lengths.max() * max(model.n, d) * np.finfo(float).eps][:components]
    if not len(order):
        return model
    chosen = axes[:, order].T
    chosen = chosen / np.sqrt((chosen**2).sum(axis=1))[:, None]
    chosen = chosen * np.sign(chosen[np.arange(len(chosen)), np.abs(chosen).argmax(axis=1)])[:, None]
    explained = (lengths[order] ** 2 / (lengths**2).sum()).tolist()
    model = Whitening(model.n, model.sums, model.largest, chosen, lengths[order] ** 2 / model.n, explained)
    return Whitening(model.n, model.sums, model.largest, chosen, model.eigenvalues, explained, _identity_error(fit, model, scratch))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, quantum: int = 256) -> tuple[Whitening, DataFrame]:
    """The model, and for each usable row vec_id, deviation and whitened (an entry for each component)."""
    scratch = Scratch(vectors.sparkSession)
    vector = F.col(f"`{vector_col}`")
    rows = vectors.where(usable(vector)).select(whole_steps(vector, quantum).alias("x"), F.col(f"`{id_col}`").alias("vec_id"))
    fit = scratch.write(lambda: rows.select("x").distinct())
    model = fit_whitening(fit, components, scratch)
    k, kind = len(model.components), rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0))
            whitened = model.project(x).tolist() if k else [[]] * len(x)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.deviations(x), pa.int64()), pa.array(whitened, pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    return model, rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")
