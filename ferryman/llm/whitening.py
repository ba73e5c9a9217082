"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Vectors pass as x = floor(1024 * c) + 100000 of each entry c. Count and sums of x are exact. The scatter is summed from
centred vectors in the tasks, a dim x dim matrix a task, and added up by entry. Only the sums and that matrix, which
depend on the dimension and not on the number of rows, reach the driver. There V = L L' is factored with complete pivoting, and
the columns of L are rotated against each other until all are orthogonal: L J = U D. The squared column norms are the
eigenvalues of V, the normalised columns its eigenvectors.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries take no part, nor do rows of
another length than the most frequent one (ties: the longest) and rows with an entry whose x has no place in a long. Equal rows
and rows of one vec_id each give their own rows; a null vec_id stays null. A component exists only up to the rank of V, so
equal vectors, a single row and an empty table give an empty result. A deviation beyond a long is null. Further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblock import column

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: rows of a task that are multiplied at once
BLOCK = 8_192


def pivoted_cholesky(v: np.ndarray, least: float = 1e-13) -> np.ndarray:
    """L (dim x rank) with L L' = v, largest remaining diagonal first; stops where that falls below ``least`` of the largest."""
    rest = np.array(np.diag(v), float)
    bound = least * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros((len(v), 0))
    for _ in range(len(v)):
        p = int(np.argmax(rest))
        if not rest[p] > bound:
            break
        row = (v[:, p] - factor @ factor[p]) / np.sqrt(rest[p])
        row[rest == 0] = 0  # pivots of earlier steps
        row[p] = np.sqrt(rest[p])
        factor = np.column_stack([factor, row])
        rest = np.maximum(rest - row * row, 0)
        rest[p] = 0
    return factor


def one_sided_jacobi(factor: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of factor @ factor'."""
    cols = np.array(factor.T, order="C")
    for _ in range(sweeps):
        turned = False
        for p in range(len(cols) - 1):
            for q in range(p + 1, len(cols)):
                a, b, c = cols[p] @ cols[p], cols[q] @ cols[q], cols[p] @ cols[q]
                if abs(c) <= tolerance * np.sqrt(a * b):
                    continue
                turned = True
                z = (b - a) / (2 * c)
                t = (1.0 if z >= 0 else -1.0) / (abs(z) + np.hypot(1.0, z))
                cos = 1 / np.hypot(1.0, t)
                cols[p], cols[q] = cos * cols[p] - cos * t * cols[q], cos * t * cols[p] + cos * cols[q]
        if not turned:
            break
    norms = np.linalg.norm(cols, axis=1)
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, (cols[order] / norms[order, None]).T if len(cols) else np.zeros((factor.shape[0], 0))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, whatever the length."""
    limit = 2.0**62 / SCALE
    bad = lambda c: c.isNull() | F.isnan(c) | ~c.cast("double").between(-limit, limit)
    return vectors.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad))


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            entries = column(part, "embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield column(part, "vec_id"), np.floor(SCALE * entries.reshape(-1, dim)).astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: longs where they hold it, else Python integers."""
    if len(x) and n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) >= 2**63:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def deviations(apart: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; null beyond a long."""
    if apart.dtype == object or not len(apart) or max(abs(int(apart.min())), abs(int(apart.max()))) ** 2 * apart.shape[1] >= 2**63:
        totals = (apart.astype(object) ** 2).sum(axis=1)
        return [int(t) if t < 2**63 else None for t in totals]
    return (apart * apart).sum(axis=1).tolist()


@dataclass
class Whitening:
    dim: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray  # dim x components

    def project(self, x: np.ndarray) -> np.ndarray:
        return (centred(x, self.n, self.sums).astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)


def summed(parts: DataFrame) -> DataFrame:
    """Sums by entry of arrays that each task has made."""
    return parts.select(F.posexplode("part").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("part"))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Three passes: the length of the vectors, count and sums, centred scatter. None where nothing is to whiten."""
    rows = usable(vectors)
    length = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if length is None:
        return None
    dim, n = length.dim, length.n
    rows = rows.filter(F.size("embedding") == dim)

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for _, x in _blocks(batches, dim):
            wide = np.abs(x).max(initial=0) > 2**48
            total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[Decimal(t) for t in total]], pa.list_(pa.decimal128(38, 0)))], names=["part"])

    found = {r.at: int(r.part) for r in summed(rows.mapInArrow(sums_of, "part array<decimal(38,0)>")).collect()}
    sums = [found[i] for i in range(dim)]

    def scatter_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for _, x in _blocks(batches, dim):
            apart = centred(x, n, sums).astype(np.float64) / n
            total += apart.T @ apart
        yield pa.RecordBatch.from_arrays([pa.array([total[np.triu_indices(dim)]], pa.list_(pa.float64()))], names=["part"])

    v = np.zeros((dim, dim))
    upper = np.triu_indices(dim)
    for r in summed(rows.mapInArrow(scatter_of, "part array<double>")).collect():
        v[upper[0][r.at], upper[1][r.at]] = v[upper[1][r.at], upper[0][r.at]] = r.part / n
    values, axes = one_sided_jacobi(pivoted_cholesky(v))
    k = min(components, len(values))
    return Whitening(dim, n, sums, float(np.trace(v)), values[:k], axes[:, :k]) if k else None


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity, from the vectors themselves."""
    k, dim = len(model.values), model.dim

    def means_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for _, x in _blocks(batches, dim):
            total += model.project(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["part"])

    mean = np.zeros(k)
    for r in summed(rows.mapInArrow(means_of, "part array<double>")).collect():
        mean[r.at] = r.part / model.n

    def products_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _blocks(batches, dim):
            apart = model.project(x) - mean
            total += apart.T @ apart
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["part"])

    cov = np.zeros(k * k)
    for r in summed(rows.mapInArrow(products_of, "part array<double>")).collect():
        cov[r.at] = r.part / model.n
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    rows = usable(vectors).filter(F.size("embedding") == model.dim)
    error, k = identity_error(rows, model), len(model.values)
    explained = model.values / model.trace

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, model.dim):
            each = np.repeat(np.arange(len(x)), k)
            apart = pa.array(deviations(centred(x, model.n, model.sums)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n, np.int64)),
                    apart.take(pa.array(each)), pa.array(model.project(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(task, SCHEMA)
