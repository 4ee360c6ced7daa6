"""Whitening of embeddings by shifted CholeskyQR (operator 12).

Entries become fixed-point integers x = floor(256 c), so means and the fit list (each
distinct x-vector once) are exact. The fit list's centred rows A are never stored: a
pass reads x, centres it, solves it through the triangles of the passes before and adds
up the Gram matrix of what results, Q. The Cholesky factor of that is the next triangle;
the first Gram matrix, and any later one that is not yet safely positive, is shifted by
11 (n d + d (d + 1)) times the rounding unit times its norm, so that the factor exists
however badly conditioned A is. Passes go on until Q's Gram matrix is that of orthonormal
columns (and of null ones, where A has not full rank). With R the product of the
triangles, A = Q R, so singular values and right vectors of R are those of A: the
components, without squaring A's condition number.

Tasks hand on a d x d matrix each, added up row by row in an exchange; the driver holds
d x d numbers, whatever the number of vectors.

Defined cases: a vector that is null or holds null or non-finite entries, or entries
beyond a long, has no rows; a vector shorter than the longest counts as filled up with
zeros (an empty one too); equal vectors count once for the fit and have rows each; null
and repeated ids are ids like others; components with an eigenvalue of rounding size
beside the largest (constant or dependent entries, a single vector) have no rows, for
nothing can be scaled by them; eigenvectors of equal eigenvalues are any orthonormal ones; a
deviation beyond a long is null; an empty table gives an empty result; other columns
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

from .common import columns_or_null, stash, work_dir

SCALE = 256
#: A pass more than these finds nothing new even where the first Gram matrix is all rounding.
MOST_PASSES = 8
#: Rows that a task works on at once are so many that x has at most this many entries.
BLOCK_ENTRIES = 1 << 20
MOST = 2**63 - 1


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: n x-vectors with sums S, components as columns, their eigenvalues, the trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int


def fixed_point(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows of ``vectors(vec_id, embedding)`` whose entries are all finite, x: array<long> of the width given, that of the longest."""
    plain = columns_or_null(vectors, {"vec_id": "long", "embedding": "array<double>"})
    fine = F.forall("embedding", lambda c: F.coalesce((F.abs(c) < F.lit(2.0**63 / SCALE)), F.lit(False)) & ~F.isnan(c))
    kept = plain.where(F.col("embedding").isNotNull() & fine)
    width = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    x = F.transform("embedding", lambda c: F.floor(c * SCALE))
    return kept.select("vec_id", F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x))).alias("x")), width


def matrix_of(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as int64."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def blocks(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_ENTRIES // max(1, width))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once where n x fits a long."""
    if x.size and max(int(x.max()), -int(x.min())) * n > MOST // 2:
        return x.astype(np.float64) - (sums.astype(object) / n).astype(np.float64)
    return (n * x - sums).astype(np.float64) / n


def solve_right(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = A for upper triangular R, column by column."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(fit: DataFrame, n: int, sums: np.ndarray, triangles: list[np.ndarray]) -> np.ndarray:
    """Gram matrix of the fit list's centred rows, solved through ``triangles`` in turn."""
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for some in blocks(batch, width):
                q = centred(matrix_of(some.column(0), width), n, sums)
                for r in triangles:
                    q = solve_right(q, r)
                total += q.T @ q
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(width), width)), pa.array(np.tile(np.arange(width), width)), pa.array(total.ravel())], names=["i", "j", "g"])

    rows = fit.select("x").mapInArrow(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    out = np.zeros((width, width))
    for r in rows:
        out[r.i, r.j] = r.g
    return (out + out.T) / 2


def triangle(g: np.ndarray, n: int, first: bool) -> np.ndarray:
    """Upper Cholesky factor of ``g``, shifted in the first pass and wherever the plain one would be all rounding."""
    d, norm, unit = len(g), np.linalg.norm(g, 2), np.finfo(np.float64).eps / 2
    shift = 11 * (n * d + d * (d + 1)) * unit * norm
    least = np.linalg.eigvalsh(g)[0]
    if first or least < min(0.1 * norm, 100 * shift):
        # rounding in g may go below zero by as much as the shift at most
        g = g + np.eye(d) * max(min(shift, 0.01 * norm), 2 * max(0.0, -least))
    return np.linalg.cholesky(g).T


def column_sums(fit: DataFrame, width: int) -> np.ndarray:
    """Exact sums per dimension: as longs, or as Python numbers where they do not fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for batch in batches:
            for some in blocks(batch, width):
                x = matrix_of(some.column(0), width)
                small = x.size and max(int(x.max()), -int(x.min())) * len(x) <= MOST
                total += (x if small else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["i", "s"])

    rows = fit.select("x").mapInArrow(run, "i long, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = {r.i: int(r.s) for r in rows}
    sums = np.array([found.get(i, 0) for i in range(width)], dtype=object)
    return sums.astype(np.int64) if all(abs(s) <= MOST for s in sums) else sums


def fit_whitening(xs: DataFrame, width: int, folder: str) -> Whitening | None:
    """Whitening of ``xs(x)``; None without rows."""
    fit = stash(xs.select("x").distinct(), f"{folder}/fit")
    n = fit.count()
    if not n or not width:
        return None
    sums = column_sums(fit, width)
    triangles: list[np.ndarray] = []
    trace = 0.0
    whole = np.eye(width)
    for k in range(MOST_PASSES):
        g = gram(fit, n, sums, triangles)
        if k == 0:
            trace = float(np.trace(g)) / n
            if not g.any():
                break
        else:
            values = np.linalg.eigvalsh(g)
            if np.abs(values * (1 - values)).max() <= 1e-13 * width:
                break
        r = triangle(g, n, first=k == 0)
        triangles.append(r)
        whole = r @ whole
    _, sigma, vt = np.linalg.svd(whole)
    real = (sigma > sigma[0] * max(n, width) * np.finfo(np.float64).eps) if triangles else np.zeros(width, dtype=bool)
    real[n - 1 :] = False  # n centred rows have a rank below n
    turned = vt * np.where(vt[np.arange(width), np.abs(vt).argmax(axis=1)] < 0, -1.0, 1.0)[:, None] if width else vt
    return Whitening(n, sums, np.ascontiguousarray(turned[real].T), sigma[real] ** 2 / n, trace, len(triangles) + 1)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S) squared, exact; None where it is beyond a long."""
    if not x.shape[1]:
        return [0] * len(x)
    most = (max(int(x.max()), -int(x.min())) * n + max(abs(int(s)) for s in sums)) if x.size else 0
    if most * most * x.shape[1] <= MOST:
        far = n * x - sums.astype(np.int64)
        return np.einsum("ij,ij->i", far, far).tolist()
    far = n * x.astype(object) - sums.astype(object)
    return [v if v <= MOST else None for v in (far * far).sum(axis=1)]


def project(x: np.ndarray, w: Whitening, most: int) -> np.ndarray:
    return centred(x, w.n, w.sums) @ (w.components[:, :most] / np.sqrt(w.eigenvalues[:most]))


def identity_error(fit: DataFrame, w: Whitening, most: int) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - identity), measured on the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(most), np.zeros((most, most))
        for batch in batches:
            for some in blocks(batch, len(w.sums)):
                y = project(matrix_of(some.column(0), len(w.sums)), w, most)
                first += y.sum(axis=0)
                second += y.T @ y
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "v"])

    rows = fit.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(most + most * most)
    for r in rows:
        values[r.i] = r.v
    mean = values[:most] / w.n
    return float(np.abs(values[most:].reshape(most, most) / w.n - np.outer(mean, mean) - np.eye(most)).max())


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error (see the contract of op12), for components 1 to ``components`` or as many as there are."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark, folder = vectors.sparkSession, work_dir(vectors.sparkSession, "whitening")
    xs, width = fixed_point(vectors)
    w = fit_whitening(xs, width, folder)
    most = min(components, len(w.eigenvalues)) if w else 0
    if not most:
        return spark.createDataFrame([], schema)
    error = identity_error(spark.read.parquet(f"{folder}/fit"), w, most)
    explained = w.eigenvalues[:most] / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in blocks(batch, len(w.sums)):
                x, rows = matrix_of(some.column(1), len(w.sums)), some.num_rows
                ids = some.column(0).take(pa.array(np.repeat(np.arange(rows), most)))
                far = pa.array(deviations(x, w.n, w.sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), most)))
                columns = [ids, pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), rows)), pa.array(np.full(rows * most, w.n)), far,
                           pa.array(project(x, w, most).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * most, error))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return xs.mapInArrow(run, schema)
