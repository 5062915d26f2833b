"""Whitening of embeddings: principal components by LOBPCG over distributed covariance-block products.

The covariance V of the fixed-point vectors (`vectors`) is never formed. Its product with a block Q of m columns is a pass over
the rows: each task gathers C' (C Q) for its centred rows C, and the tasks' blocks are summed by Spark, so the driver gets dims * m
numbers however many rows there are. C is (n * x - S) / n with S the exact sums, so it carries one rounding, wherever the mean lies.

LOBPCG keeps a block X of more columns than are wanted. Each round spans X, its residuals V X - X E and the last round's
directions by an orthonormal basis Q (rank-revealing: columns that add nothing go), asks for V Q in one pass and takes the leading
eigenvectors of Q'VQ as the new X (Rayleigh-Ritz). It ends when all wanted residuals are within tol of the largest eigenvalue, and this
is certified by a product V X made anew. Where the basis spans all dimensions a round is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow
from .vectors import exact_sum, fixed_point, list_array, matrix, parts

COMPONENTS, GUARD, TOL, MAX_ROUNDS = 32, 8, 1e-12, 500
OFFSET = 1_000_000
#: Components whose eigenvalue is this small a part of the largest are rounding and can't be divided by.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n, the exact sums S, eigenvalues (falling) with unit eigenvectors as columns, the trace, certified residual norms, and how far whitened is from white."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    columns: np.ndarray
    trace: float
    residuals: np.ndarray
    identity_error: float
    rounds: int


def centring(n: int, sums: tuple[int, ...], reach: int) -> Callable[[np.ndarray], np.ndarray]:
    """x -> n * x - S, exact: longs where they can't overflow, else Python's integers. reach: no entry of x is further from zero."""
    about = [s // n for s in sums]
    rest = [s - n * a for s, a in zip(sums, about, strict=True)]  # in [0, n)
    if n * (reach + max(map(abs, about)) + 1) < 1 << 62:
        about, rest = np.array(about, np.int64), np.array(rest, np.int64)
        return lambda x: n * (x - about) - rest
    about, rest = np.array(about, object), np.array(rest, object)
    return lambda x: n * (x.astype(object) - about) - rest


def _sums(rows: DataFrame, dims: int) -> tuple[int, tuple[int, ...], int]:
    """n, S and the largest entry's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, reach = 0, [0] * dims, 0
        for part in parts(batches):
            x = matrix(part.column(0), dims)
            n, reach = n + len(x), max(reach, int(np.abs(x).max()))
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            total = [t + (h << 32) + w for t, h, w in zip(total, high, low, strict=True)]
        if n:
            high, low = zip(*[divmod(t, 1 << 32) for t in total], strict=True)
            yield pa.RecordBatch.from_pydict({"at": list(range(dims)), "n": [n] * dims, "reach": [reach] * dims, "high": high, "low": low}, pa.schema([(c, pa.int64()) for c in ("at", "n", "reach", "high", "low")]))

    each = map_arrow(rows.select("x"), run, "at long, n long, reach long, high long, low long")
    got = sorted(each.groupBy("at").agg(F.sum("n").alias("n"), F.max("reach").alias("reach"), exact_sum("high").alias("high"), exact_sum("low").alias("low")).collect())
    return (got[0].n, tuple((int(r.high) << 32) + int(r.low) for r in got), got[0].reach) if got else (0, (), 0)


def _product(rows: DataFrame, model: tuple[int, tuple[int, ...], int], block: np.ndarray, project: bool = False) -> np.ndarray:
    """V block, and the trace of V after it as a further row; project: block' V block instead."""
    n, dims, width = model[0], len(model[1]), block.shape[1]
    height = width if project else dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, total, spread, any_ = centring(*model), np.zeros((height, width)), 0.0, False
        for part in parts(batches):
            c = centre(matrix(part.column(0), dims)).astype(np.float64) / n
            along = c @ block
            total += (along if project else c).T @ along
            spread, any_ = spread + float((c * c).sum()), True
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, total.size)), pa.array(np.concatenate([[spread], total.ravel()]))], names=["at", "v"])

    got = map_arrow(rows.select("x"), run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(height * width + 1)
    for r in got:
        out[r.at] = r.v
    return np.concatenate([out[:-1].reshape(height, width), np.full((1, width), out[-1])]) / n


def orthonormal(x: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """x (orthonormal columns) followed by an orthonormal basis of what the further blocks add to its span."""
    for block in more:
        length = np.linalg.norm(block, axis=0)
        block = block[:, length > 0] / length[length > 0]
        for _ in range(2):  # twice is enough
            block = block - x @ (x.T @ block)
            if block.shape[1]:
                u, s, _ = np.linalg.svd(block, full_matrices=False)
                block = u[:, s > 1e-10]
        block, _ = np.linalg.qr(block - x @ (x.T @ block))
        x = np.concatenate([x, block[:, : x.shape[0] - x.shape[1]]], axis=1)
    return x


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int, guard: int = GUARD, tol: float = TOL, max_rounds: int = MAX_ROUNDS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues (falling), unit eigenvectors, certified residual norms and the number of rounds of the symmetric matrix behind product."""

    def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = q.T @ vq
        e, c = np.linalg.eigh((h + h.T) / 2)
        return e[::-1][:m], c[:, ::-1][:, :m]

    m = min(dims, k + guard)
    x, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, m)))
    vx = product(x)
    e, c = ritz(x, vx)
    x, vx, p = x @ c, vx @ c, np.zeros((dims, 0))
    for rounds in range(max_rounds + 1):
        residual = vx - x * e
        if (np.linalg.norm(residual[:, :k], axis=0) <= tol * max(e[0], 0.0)).all():
            vx = product(x)  # anew: what is certified isn't carried over from earlier products
            residual = vx - x * e
            norms = np.linalg.norm(residual[:, :k], axis=0)
            if (norms <= 2 * tol * max(e[0], 0.0)).all():
                return e[:k], x[:, :k], norms, rounds
        q = orthonormal(x, residual, p)
        vq = np.concatenate([vx, product(q[:, m:])], axis=1) if q.shape[1] > m else product(q)
        e, c = ritz(q, vq)
        p = q[:, m:] @ c[m:]
        x, vx = q @ c, vq @ c
        # Columns drift from orthonormal by rounding; a thin QR sets them right and changes nothing else.
        x, r = np.linalg.qr(x)
        vx = np.linalg.solve(r.T, vx.T).T
        x, vx = x * np.sign(np.diag(r)), vx * np.sign(np.diag(r))
    raise RuntimeError("the residuals did not come within the tolerance")


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", guard: int = GUARD, tol: float = TOL) -> tuple[DataFrame, Whitening | None]:
    """The rows that count (vec_id, x; a table in the shared folder) and the whitening fitted to all of them; None where no row counts.

    Null vectors and vectors with null or non-finite entries (and empty ones) don't count. Vectors are of one length; where they aren't, the length
    of the most rows counts (ties: the longer). Repeated rows and null ids are rows like any other. Directions without spread have
    no whitened value: components end where the eigenvalue is 1e-12 of the largest or less, so equal vectors alone have none.
    """
    rows = fixed_point(vectors, column, offset=OFFSET)
    lengths = sorted(((r.n, r.dims) for r in rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()), reverse=True)
    if not lengths:
        return rows, None
    dims = lengths[0][1]
    rows = cut(rows.where(F.size("x") == dims), "vectors")
    model = _sums(rows, dims)
    trace = [0.0]

    def product(block: np.ndarray) -> np.ndarray:
        out = _product(rows, model, block)
        trace[0] = float(out[-1, 0])
        return out[:-1]

    values, columns, residuals, rounds = lobpcg(product, dims, min(components, dims), guard, tol)
    spread = (values > FLAT * max(values[0], 0.0)) & (values > 0)
    values, columns, residuals = values[spread], columns[:, spread], residuals[spread]
    error = 0.0
    if len(values):
        # The centred rows sum to zero exactly, so this is the whitened rows' covariance.
        error = float(np.abs(_product(rows, model, columns / np.sqrt(values), project=True)[:-1] - np.eye(len(values))).max())
    return rows, Whitening(model[0], model[1], values, columns, trace[0], residuals, error, rounds)


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """vec_id, deviation (decimal; the exact sum over dimensions of (n * x - S) ** 2), whitened (one double a component) for each row of fit_whitening's."""
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return rows.select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).limit(0)
    n, sums, dims, across = model.n, model.sums, len(model.sums), model.columns / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            x = matrix(part.column(1), dims)
            c = centring(n, sums, int(np.abs(x).max()))(x)
            if c.dtype != object and dims * int(np.abs(c).max()) ** 2 < 1 << 63:
                deviation = pa.array((c * c).sum(1)).cast(pa.decimal128(38, 0))
            else:
                total = [sum(v * v for v in row) for row in c.tolist()]
                deviation = pa.array([str(t) if t < 10**38 else None for t in total]).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([part.column(0), deviation, list_array(c.astype(np.float64) / n @ across)], names=["vec_id", "deviation", "whitened"])

    return map_arrow(rows.select("vec_id", "x"), run, schema)


def whitened_components(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error, eigenvalue; a row for each row that counts and each component.

    A deviation that no long holds is null. See fit_whitening for the rows and components that count.
    """
    rows, model = fit_whitening(vectors, components, column)
    out = whiten(rows, model).select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    n, values, trace, error = (model.n, model.values, model.trace, model.identity_error) if model else (0, np.zeros(0), 1.0, 0.0)
    of = lambda v: F.get(F.array(*[F.lit(float(x)) for x in v]).cast("array<double>"), F.col("at"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", of(values / trace).alias("explained"), F.lit(error).alias("identity_error"), of(values).alias("eigenvalue"))
