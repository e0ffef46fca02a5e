"""Whitening of embeddings from an exact integer scatter matrix, built bit plane by bit plane.

Every entry c becomes the integer ``floor(scale * c) + offset``.  Tasks take blocks of rows,
shift each dimension by its smallest value in the block and pack the bits of equal weight of
64 rows into one word.  The sum of ``2**(p+q) * popcount(plane_p & plane_q)`` over all pairs
of planes is a block's cross-product; shifted back, in whole numbers, blocks add up to the
scatter matrix of the table.  It is centred as integers (``n * sum(x*y) - sum(x) * sum(y)``)
before it is rounded once to doubles for ``eigh`` on the driver.  Only dims * dims sums leave
a task, so what travels does not depend on the rows.

Defined cases: vectors that are null or empty, hold null or non-finite entries, or entries
whose integer does not fit 62 bits, are left out; so are those of another length than most
have (ties: the longest).  Rows with a null id and repeated rows are rows like others.  A
component without variance (also of a single row) has a null ``whitened`` and takes no part
in ``identity_error``.  An empty table, or one without a usable vector, gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = 4096                     # rows whose planes are packed together
SCALE, OFFSET = 1024.0, 100_000
LIMIT = 2.0 ** 62
HALF = 10 ** 18                  # sums travel as two parts, each far from 38 digits
ROWS_OUT = 20_000


@dataclass
class Whitening:
    """What a fit gives: all plain numbers of the size of the dimensions."""
    dims: int
    rows: int
    sums: list[int]
    values: np.ndarray           # eigenvalues of the covariance, falling
    vectors: np.ndarray          # unit eigenvectors, one a column
    trace: float

    def scaled(self, components: int) -> np.ndarray:
        """Columns to project centred rows on: eigenvector / sqrt(eigenvalue), NaN without variance."""
        e = self.values[:components]
        least = max(self.trace, 0.0) * self.dims * 2.0 ** -52
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(e > least, self.vectors[:, :components] / np.sqrt(np.abs(e)), np.nan)


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors whose entries are all finite and in range, of any length."""
    vec = F.col(vec_col).cast("array<double>")
    fits = F.forall("vec", lambda c: F.coalesce(F.abs(c * SCALE) < LIMIT, F.lit(False)))
    return (table.select(F.col(id_col).alias("id"), vec.alias("vec"))
            .where(F.col("vec").isNotNull() & (F.size("vec") > 0) & fits))


def _integers(vectors: pa.Array, dims: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dims) + OFFSET


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, upper triangle of the cross-products) of integer rows, as Python integers."""
    rows, dims = x.shape
    low = x.min(axis=0)
    y = x.view(np.uint64) - low.view(np.uint64)
    planes = max(int(y.max()).bit_length(), 1)
    words = -(-rows // 64)
    packed = np.zeros((dims, planes, words), dtype=np.uint64)
    for p in range(planes):
        bits = np.packbits(((y >> np.uint64(p)) & np.uint64(1)).astype(np.uint8).T, axis=1)
        packed[:, p].view(np.uint8)[:, :bits.shape[1]] = bits
    exact = object if 2 * planes + rows.bit_length() > 62 else np.int64
    weight = np.array([1 << p for p in range(planes)], dtype=exact)
    total = np.bitwise_count(packed).sum(axis=2, dtype=np.int64).astype(exact) @ weight
    cross = np.zeros((dims, dims), dtype=object)
    for a in range(dims):
        row = np.zeros(dims - a, dtype=exact)
        for p in range(planes):
            both = np.bitwise_count(packed[a:] & packed[a, p]).sum(axis=2, dtype=np.int64)
            row = row + weight[p] * (both.astype(exact) @ weight)
        cross[a, a:] = row.astype(object)
    low, total = low.astype(object), total.astype(object)
    cross = cross + np.triu(np.outer(low, total) + np.outer(total, low) + rows * np.outer(low, low))
    return total + rows * low, cross


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        x = _integers(batch.column("vec"), dims)
        while len(x):
            take = x[:BLOCK - n]
            held.append(take)
            n += len(take)
            x = x[len(take):]
            if n == BLOCK:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def _scatter(dims: int):
    """(a, b, hi, lo): a task's part of sum a*b; of sum a for b = -1; of the rows for a = b = -1."""
    def run(batches):
        n, sums, cross = 0, 0, 0
        for x in _blocks(batches, dims):
            s, c = cross_products(x)
            n, sums, cross = n + len(x), sums + s, cross + c
        if n:
            a, b = np.triu_indices(dims)
            cells = [n, *sums.tolist(), *cross[a, b].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([[-1], np.arange(dims), a]).astype(np.int32)),
                 pa.array(np.concatenate([[-1], np.full(dims, -1), b]).astype(np.int32)),
                 pa.array([Decimal(v // HALF) for v in cells], pa.decimal128(38, 0)),
                 pa.array([Decimal(v % HALF) for v in cells], pa.decimal128(38, 0))], ["a", "b", "hi", "lo"])
    return run


def fit(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> Whitening | None:
    """The whitening of all usable vectors, or None if there are none."""
    rows = usable(table, id_col, vec_col)
    common = (rows.groupBy(F.size("vec").alias("dims")).count()
              .orderBy(F.col("count").desc(), F.col("dims").desc()).first())
    if common is None:
        return None
    dims = common["dims"]
    parts = (rows.where(F.size("vec") == dims).select("vec")
             .mapInArrow(_scatter(dims), "a int, b int, hi decimal(38,0), lo decimal(38,0)"))
    # dims * (dims + 1) / 2 + dims + 1 rows, whatever the table holds
    cell = {(r["a"], r["b"]): int(r["hi"]) * HALF + int(r["lo"])
            for r in parts.groupBy("a", "b").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()}
    n, sums = cell[-1, -1], [cell[a, -1] for a in range(dims)]
    covariance = np.zeros((dims, dims))
    for a in range(dims):
        for b in range(a, dims):
            covariance[a, b] = covariance[b, a] = (n * cell[a, b] - sums[a] * sums[b]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    return Whitening(dims, n, sums, values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(covariance)))


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S as whole numbers: int64 where they surely fit, else Python integers."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if model.rows * most + max(map(abs, model.sums)) < 1 << 62:
        return model.rows * x - np.array(model.sums, dtype=np.int64)
    return model.rows * x.astype(object) - np.array(model.sums, dtype=object)


def _deviations(t: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exact."""
    most, dims = int(np.abs(t).max(initial=0)), t.shape[1]
    if dims * most * most < 1 << 62:
        return pa.array((t * t).sum(axis=1)).cast(pa.decimal128(38, 0))
    if most < 1 << 52 and dims <= 1 << 10:
        hi, lo = t >> 26, t & (1 << 26) - 1
        parts = zip((hi * hi).sum(axis=1).tolist(), (hi * lo).sum(axis=1).tolist(), (lo * lo).sum(axis=1).tolist())
        exact = [(a << 52) + (b << 27) + c for a, b, c in parts]
    else:
        wide = t.astype(object)
        exact = (wide * wide).sum(axis=1).tolist()
    # a sum past 38 digits has no place in the column
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in exact], pa.decimal128(38, 0))


def _moments(model: Whitening, components: int):
    """(a, b, v): a task's sums of whitened a*b, and of a for b = -1."""
    basis = model.scaled(components)

    def run(batches):
        square, plain, seen = 0.0, 0.0, False
        for x in _blocks(batches, model.dims):
            w = (_centred(x, model) / model.rows).astype(np.float64) @ basis
            square, plain, seen = square + w.T @ w, plain + w.sum(axis=0), True
        if seen:
            k = basis.shape[1]
            a, b = (i.reshape(-1) for i in np.indices((k, k)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, np.arange(k)]).astype(np.int32)),
                 pa.array(np.concatenate([b, np.full(k, -1)]).astype(np.int32)),
                 pa.array(np.concatenate([square.reshape(-1), plain]))], ["a", "b", "v"])
    return run


def identity_error(table: DataFrame, model: Whitening, components: int = 8, id_col: str = "vec_id",
                   vec_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, measured."""
    rows = usable(table, id_col, vec_col).where(F.size("vec") == model.dims).select("vec")
    sums = rows.mapInArrow(_moments(model, components), "a int, b int, v double").groupBy("a", "b").agg(F.sum("v").alias("v"))
    cell = {(r["a"], r["b"]): r["v"] / model.rows for r in sums.collect()}       # components squared
    live = [k for k in range(min(components, model.dims)) if not np.isnan(model.scaled(components)[0, k])]
    return max((abs(cell[a, b] - cell[a, -1] * cell[b, -1] - (a == b)) for a in live for b in live), default=None)


def _project(model: Whitening, components: int, error: float | None):
    basis = model.scaled(components)
    k = basis.shape[1]
    share = [float(e / model.trace) if model.trace > 0 else None for e in model.values[:k]]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(low, ROWS_OUT)
                t = _centred(_integers(part.column("vec"), model.dims), model)
                w = (t / model.rows).astype(np.float64) @ basis
                n = len(t)
                each = pa.array(np.repeat(np.arange(n), k))
                flat = w.reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                     pa.array(np.full(n * k, model.rows, dtype=np.int64)), _deviations(t).take(each),
                     pa.array(flat, mask=np.isnan(flat)), pa.array(share * n, pa.float64()),
                     pa.array([error] * (n * k), pa.float64())],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable vector and component (id, component, n, deviation, whitened, explained,
    identity_error); components by falling eigenvalue, from 1."""
    rows = usable(table, id_col, vec_col)
    schema = (f"id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), "
              "whitened double, explained double, identity_error double")
    model = fit(table, id_col, vec_col)
    if model is None:
        out = table.sparkSession.createDataFrame([], schema)
    else:
        error = identity_error(table, model, components, id_col, vec_col)
        out = rows.where(F.size("vec") == model.dims).mapInArrow(_project(model, components, error), schema)
    return out.withColumnRenamed("id", id_col)
