"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Entries are put on a grid of integers (``floor(scale * c) + shift``), so that counts, sums and the
scatter are exact whatever the order of the rows.  The model is fitted on the distinct vectors:

* their number and sums by dimension;
* their scatter about the rounded mean: centred before it is multiplied, summed in
  integers, and moved from the rounded to the exact mean (less than half a unit away) as fractions;
* a Cholesky factor of the covariance with pivoting, which stops where the rest is rounding;
* Jacobi rotations from the right of that triangular factor until its columns are orthogonal:
  their squared norms are the eigenvalues and the normalised columns are the components.
  Pairs of columns that have no column in common are rotated together;
* the covariance of the whitened distinct vectors, measured against the identity.

On Spark the distinct vectors are a written table; tasks reduce their rows to a matrix of the size of the
dimension, which is summed by entry.  Only matrices of that size reach the driver, never rows.

Defined cases: vectors that are NULL, empty, or have an entry that is NULL or not finite, or too large for a
64-bit integer on the grid, are dropped; so are vectors of another length than most have
(ties: the shortest).  Repeated rows are each scored, but fitted once.  Components without
variance (below rounding) don't exist, so equal vectors, one vector or none give no component. ``deviation`` is NULL
beyond 64 bits.  NULL keys stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import shared_folder

BLOCK = 2048                               # rows multiplied at once
EXACT = 2.0**53                            # integers up to here are exact in doubles
LARGE = 2.0**62                            # entries on the grid stay below


@dataclass
class Model:
    n: int                                 # distinct vectors
    sums: list[int]                        # by dimension
    trace: float                           # of the covariance
    values: np.ndarray                     # eigenvalues, falling
    components: np.ndarray                 # a row a component
    identity_error: float = 0.0
    scale: int = 64
    shift: int = 1_000_000


def on_grid(vectors: DataFrame, vector: str, scale: int, shift: int) -> Column:
    """The integer vector, NULL if the vector takes no part."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale) + shift)
    fits = F.forall(F.col(vector), lambda c: F.coalesce(
        (F.abs(c.cast("double")) < LARGE / scale) & ~F.isnan(c.cast("double")), F.lit(False)))
    return F.when(fits & (F.size(vector) > 0), x)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column(batch.num_columns - 1).flatten()).reshape(batch.num_rows, -1)


def _gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y in exact integers (Python's, where 64 bits or doubles do not suffice)."""
    top = int(max(y.max(), -y.min()))
    if top ** 2 * len(y) < EXACT:
        return (y.astype(float).T @ y).astype(np.int64).astype(object)
    high, low = y >> 20, y & 0xFFFFF       # y = high * 2**20 + low, low >= 0
    if max(abs(int(high.max())), abs(int(high.min()))) ** 2 * len(y) < EXACT and len(y) <= 2 * BLOCK:
        cross = (high.astype(float).T @ low).astype(np.int64).astype(object)
        return (_gram(high) << 40) + ((cross + cross.T) << 20) + _gram(low)
    y = y.astype(object)
    return y.T @ y


def _summed(rows: DataFrame, run, dim: int) -> np.ndarray:
    """The sum of the integer matrices that ``run`` makes of each partition, by entry."""
    cells = rows.mapInArrow(run, "i int, j int, v decimal(38,0)")
    out = np.zeros((dim, dim), object)
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():     # of the dimension's size
        out[r.i, r.j] = int(r.v)
    return out


def _cells(m: np.ndarray) -> pa.RecordBatch:
    i, j = np.nonzero(np.ones(m.shape, bool))
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
         pa.array([int(x) for x in m[i, j]], pa.decimal128(38, 0))], ["i", "j", "v"])


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(factor, order)``: ``v[order][:, order] = factor @ factor.T`` with a lower triangular factor of as
    many columns as ``v`` has rank."""
    v, d = v.copy(), len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    floor = np.finfo(float).eps * d * max(v.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(v.diagonal()[k:]))
        if v[p, p] <= floor:
            return factor[:, :k], order
        for m in (v, v.T, factor):
            m[[k, p]] = m[[p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(v[k, k])
        factor[k + 1:, k] = v[k + 1:, k] / factor[k, k]
        v[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def one_sided_jacobi(a: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``a`` times a rotation, with orthogonal columns."""
    a, n = a.copy(), a.shape[1]
    players = list(range(n)) + [-1] * (n % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1):                             # a round: every column in one pair
            pairs = [(x, y) for x, y in zip(players[:len(players) // 2], players[:len(players) // 2 - 1:-1],
                                            strict=True) if x >= 0 and y >= 0]
            players[1:] = players[-1:] + players[1:-1]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            go = np.abs(xy) > np.finfo(float).eps * np.sqrt(xx) * np.sqrt(yy)
            if not go.any():
                continue
            turned = True
            p, q, x, y, xx, yy, xy = p[go], q[go], x[:, go], y[:, go], xx[go], yy[go], xy[go]
            zeta = (yy - xx) / (2 * xy)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            a[:, p], a[:, q] = c * (x - t * y), c * (t * x + y)
        if not turned:
            break
    return a


def decompose(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(eigenvalues, components)`` of a covariance, falling, as many as its rank; a row a component,
    whose largest entry is positive."""
    factor, order = pivoted_cholesky(cov)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    rank = np.argsort(-norms, kind="stable")
    parts = np.zeros((len(rank), len(cov)))
    parts[:, order] = (turned[:, rank] / norms[rank]).T
    sign = np.sign(parts[np.arange(len(parts)), np.argmax(np.abs(parts), axis=1)]) if len(parts) else 1.0
    return norms[rank] ** 2, parts * np.reshape(sign, (-1, 1))


def _projected(y: np.ndarray, rest: list[int], n: int, m: Model, k: int) -> np.ndarray:
    """Whitened rows; y is x less the rounded mean, whose sums over the fit list are ``rest``."""
    away = y - np.array([r / n for r in rest])
    return away @ (m.components[:k] / np.sqrt(m.values[:k])[:, None]).T


def fit(vectors: DataFrame, *, vector: str = "embedding", components: int = 16, scale: int = 64,
        shift: int = 1_000_000) -> Model:
    """The model of the distinct vectors of ``vectors``, with at most ``components`` components."""
    spark = vectors.sparkSession
    ship_package(spark)
    x = vectors.select(on_grid(vectors, vector, scale, shift).alias("x")).where("x is not null")
    sizes = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    if sizes is None:
        return Model(0, [], 0.0, np.zeros(0), np.zeros((0, 0)), 0.0, scale, shift)
    dim, folder = sizes.dim, shared_folder(spark, "whitening")
    x.where(F.size("x") == dim).distinct().write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(dim, object), 0
        for b in batches:
            if len(b):
                y = _matrix(b)             # below 2**62, so sums of halves of the bits fit
                sums = sums + ((y >> 31).sum(0).astype(object) << 31) + (y & 0x7FFFFFFF).sum(0)
                n += len(b)
        if n:
            yield _cells(np.array([[*sums, n]], object))
    got = _summed(rows, add, dim + 1)[0]
    n, sums = int(got[dim]), [int(s) for s in got[:dim]]
    middle = [round(Fraction(s, n)) for s in sums]
    rest = [s - n * c for s, c in zip(sums, middle, strict=True)]
    centre = np.array(middle, np.int64)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dim, dim), object)
        for b in batches:
            y = _matrix(b) - centre if len(b) else np.zeros((0, dim), np.int64)
            for i in range(0, len(y), BLOCK):
                out = out + _gram(y[i:i + BLOCK])
        if out.any():
            yield _cells(out)
    whole = _summed(rows, scatter, dim)
    cov = np.array([[float(Fraction(n * int(whole[i, j]) - rest[i] * rest[j], n * n)) for j in range(dim)]
                    for i in range(dim)])
    values, parts = decompose(cov)
    model = Model(n, sums, float(cov.trace()), values[:components], parts[:components], 0.0, scale, shift)

    k = len(model.values)

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 1, k))         # products, and the sums
        for b in batches:
            if len(b):
                w = _projected(_matrix(b) - centre, rest, n, model, k)
                out += np.vstack([w.T @ w, w.sum(0)])
        i, j = np.nonzero(np.ones(out.shape, bool))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                          pa.array(out[i, j], pa.float64())], ["i", "j", "v"])
    if k:
        total = np.zeros((k + 1, k))
        for r in rows.mapInArrow(white, "i int, j int, v double").groupBy("i", "j") \
                .agg(F.sum("v").alias("v")).collect():
            total[r.i, r.j] = r.v
        mean = total[k] / n                # zero but for rounding
        model.identity_error = float(np.abs(total[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def transform(vectors: DataFrame, model: Model, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, deviation, whitened)`` of every vector that takes part; ``deviation`` is the sum over dimensions
    of ``(n * x - sum)**2``, ``whitened`` has a number a component of the model."""
    ship_package(vectors.sparkSession)
    n, dim, k = model.n, len(model.sums), len(model.values)
    middle = [round(Fraction(s, n)) for s in model.sums]
    rest = [s - n * c for s, c in zip(model.sums, middle, strict=True)]
    centre = np.array(middle, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            y = _matrix(b) - centre
            most = n * int(max(y.max(), -y.min())) + max(map(abs, rest))
            if dim * most ** 2 < 2**63:
                away = n * y - np.array(rest, np.int64)
                deviation = (away * away).sum(1).tolist()
            else:
                away = n * y.astype(object) - np.array(rest, object)
                deviation = [d if d < 2**63 else None for d in (away * away).sum(1).tolist()]
            w = _projected(y, rest, n, model, k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(deviation, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()) if k else
                                          pa.array(np.zeros(len(b) + 1), pa.int32()), pa.array(w.ravel()))],
                [key, "deviation", "whitened"])

    x = on_grid(vectors, vector, model.scale, model.shift)
    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType)]) \
        .add("deviation", "long").add("whitened", T.ArrayType(T.DoubleType()))
    return vectors.select(F.col(key), x.alias("_x")).where(F.size("_x") == dim).mapInArrow(run, schema)
