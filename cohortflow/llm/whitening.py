"""Whitening of vectors by a distributed covariance and a symmetric eigensolver of its own.

Entries become whole numbers, ``floor(scale * c) + offset``, so that counts and sums are exact in any order. A first pass adds
up the count and the sums of each dimension, a second the covariance of the centred entries: every task keeps one matrix of
dim x dim, and only its upper triangle is shuffled. The driver holds that one matrix. It is brought to tridiagonal form by
Householder reflections; the leading eigenvalues are bracketed by Sturm counts and bisected down to neighbouring doubles;
their vectors come from inverse iteration, with those of a cluster of eigenvalues made orthogonal to one another in each
step, and are turned back by the reflections. The projection (dim x components) is sent to the tasks, which whiten the rows
where they are. Last, the covariance of what came out is measured over all rows, centred again, against the identity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ship

#: Whole numbers at or above this are not exact as doubles; an entry that far out counts as not finite.
LARGEST = float(1 << 52)
_EPS = np.finfo(float).eps


@dataclass
class Whitening:
    """``n`` vectors of ``dim`` entries were fitted: their exact ``sums``, the ``trace`` of their covariance, its leading
    eigenvalues (falling) and unit eigenvectors (one row each)."""

    n: int
    sums: np.ndarray
    scale: float
    offset: int
    trace: float = 0.0
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None

    @property
    def dim(self) -> int:
        return len(self.sums)

    def projection(self) -> np.ndarray:
        """dim x components; a component without variance (down to rounding) is a column of NaN."""
        floor = self.dim * _EPS * max(float(self.values[0]), 0.0) if len(self.values) else 0.0
        each = np.array([1 / np.sqrt(e) if e > floor else np.nan for e in self.values])
        return (self.vectors * each[:, None]).T


# ------------------------------------------------------------------ eigensolver

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal, off-diagonal and the unit reflection vectors of a symmetric matrix."""
    a, n = np.array(a, float), len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size and np.any(v[1:]):
            v[0] += np.copysign(size, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1:, k + 1:]
            p = rest @ v
            w = p - (v @ p) * v
            rest -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1, k] = a[k, k + 1] = -np.copysign(size, a[k + 1, k])
            a[k + 2:, k] = a[k, k + 2:] = 0
        else:
            v = np.zeros(n - k - 1)
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def sturm_count(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each ``x``: the negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny / _EPS
    q = d[0] - x
    count = (q < 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected until no double lies between its bounds (or they are within
    rounding of the matrix's size)."""
    n = len(d)
    reach = np.abs(np.r_[e, 0]) + np.abs(np.r_[0, e])
    lo, hi = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    size = max(abs(lo[0]), abs(hi[0]), np.finfo(float).tiny)
    lo, hi = lo - 4 * _EPS * size, hi + 4 * _EPS * size
    rank = n - np.arange(k)  # the first is the n-th smallest
    while True:
        mid = (lo + hi) / 2
        live = (mid > lo) & (mid < hi) & (hi - lo > 1e-3 * _EPS * size)
        if not live.any():
            return mid
        below = sturm_count(d, e, mid) >= rank
        hi, lo = np.where(live & below, mid, hi), np.where(live & ~below, mid, lo)


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) y = b by elimination with row exchanges; a vanishing pivot is taken as ``tiny``."""
    n = len(d)
    u, v, w, y = d - shift, np.r_[e, 0.0], np.zeros(n), b.copy()  # the three upper diagonals
    for i in range(n - 1):
        low, nxt, far = e[i], u[i + 1], v[i + 1]
        if abs(low) > abs(u[i]):  # the next row comes up
            m = u[i] / low
            u[i], u[i + 1] = low, v[i] - m * nxt
            v[i], v[i + 1] = nxt, -m * far
            w[i] = far
            y[i], y[i + 1] = y[i + 1], y[i] - m * y[i + 1]
        else:
            if abs(u[i]) < tiny:
                u[i] = tiny
            m = low / u[i]
            u[i + 1] = nxt - m * v[i]
            y[i + 1] -= m * y[i]
    for i in range(n - 1, -1, -1):
        if abs(u[i]) < tiny:
            u[i] = np.copysign(tiny, u[i])
        s = y[i]
        if i + 1 < n:
            s -= v[i] * y[i + 1]
        if i + 2 < n:
            s -= w[i] * y[i + 2]
        y[i] = s / u[i]
        if abs(y[i]) > 1e150:  # only the direction matters
            y /= abs(y[i])
    return y


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, steps: int = 6, seed: int = 5) -> np.ndarray:
    """Unit eigenvectors (rows) by inverse iteration. Eigenvalues within a thousandth of the matrix's size of their
    neighbour form a cluster, whose vectors are made orthogonal to one another after every step."""
    size = max(np.abs(d).max(), np.abs(e).max() if len(e) else 0.0, np.finfo(float).tiny)
    rng, out, begin = np.random.default_rng(seed), np.zeros((len(values), len(d))), 0
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * size:
            begin = i
        shift = value
        if i > begin:  # equal eigenvalues need shifts that differ
            shift = min(value, last - 4 * _EPS * size)
        last = shift
        y = rng.standard_normal(len(d))
        for _ in range(steps):
            y = _solve(d, e, shift, y / np.linalg.norm(y), _EPS * size)
            for _ in range(2):
                y -= out[begin:i].T @ (out[begin:i] @ (y / np.linalg.norm(y))) * np.linalg.norm(y)
        out[i] = y / np.linalg.norm(y)
    return out


def leading_pairs(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    k = min(k, len(a))
    top = np.abs(a).max() if a.size else 0.0
    if not top:
        return np.zeros(k), np.eye(len(a))[:k]
    d, e, mirrors = tridiagonal(a / top)
    values = leading_values(d, e, k)
    vectors = leading_vectors(d, e, values)
    for at in range(len(mirrors) - 1, -1, -1):
        part = vectors[:, at + 1:]
        part -= 2 * np.outer(part @ mirrors[at], mirrors[at])
    return values * top, vectors


# ------------------------------------------------------------------ passes over the rows

def _numbers(col: pa.Array, scale: float, offset: int):
    """(rows that take part, their lengths, their whole numbers end to end)."""
    flat = col.flatten()
    real = np.asarray(pc.is_valid(flat))
    x = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).astype(np.float64) * scale
    fine = real & (np.abs(x) < LARGEST)  # False for NaN
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(size)]
    bad = np.r_[0, np.cumsum(~fine)]
    ok = (bad[ends[1:]] == bad[ends[:-1]]) & (size > 0)
    x = np.floor(np.where(fine, x, 0)).astype(np.int64) + offset
    return ok, size, x, ends[:-1]


def _matrix(col: pa.Array, scale: float, offset: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``dim`` fine entries, their whole numbers)."""
    ok, size, x, begin = _numbers(col, scale, offset)
    rows = np.flatnonzero(ok & (size == dim))
    return rows, x[begin[rows, None] + np.arange(dim)] if len(rows) else np.empty((0, dim), np.int64)


def _sums(scale: float, offset: int):
    """Rows (dim, place, n, total): for each length of vector its count and the sums of its dimensions."""
    def out(held):
        for dim, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dim, dim)), pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(total)],
                names=["dim", "place", "n", "total"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ok, size, x, begin = _numbers(batch.column(0), scale, offset)
            for dim in np.unique(size[ok]).tolist():
                rows = np.flatnonzero(ok & (size == dim))
                n, total = held.setdefault(dim, [0, np.zeros(dim, np.int64)])
                held[dim] = [n + len(rows), total + x[begin[rows, None] + np.arange(dim)].sum(axis=0)]
            if sum(held) > 1 << 20:  # ragged vectors: what has been counted goes on to Spark's sum
                yield from out(held)
                held = {}
        yield from out(held)
    return run


def _apart(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """n * x - sums, exact; Python's whole numbers where they would not fit 64 bits."""
    if len(x) and fit.n * int(np.abs(x).max()) >= 1 << 62:
        return fit.n * x.astype(object) - fit.sums.astype(object)
    return fit.n * x - fit.sums


def _products(fit: Whitening):
    """Rows (i, j, v): the upper triangle of the sum of products of centred entries."""
    i, j = np.triu_indices(fit.dim)

    def run(batches):
        total, seen = np.zeros((fit.dim, fit.dim)), False
        for batch in batches:
            _, x = _matrix(batch.column(0), fit.scale, fit.offset, fit.dim)
            c = (_apart(x, fit) / fit.n).astype(np.float64)
            total += c.T @ c
            seen |= len(x) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])
    return run


def _deviation(apart: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None where it does not fit a long."""
    about = (apart.astype(np.float64) ** 2).sum(axis=1)
    if not len(about) or (about.max() < 9e18 and apart.dtype != object):
        return (apart * apart).sum(axis=1).tolist()
    out = []
    for row, size in zip(apart, about, strict=True):
        exact = sum(int(v) ** 2 for v in row) if size < 1e19 else 1 << 63
        out.append(exact if exact < 1 << 63 else None)
    return out


def _projected(fit: Whitening):
    matrix = fit.projection()

    def run(batches):
        for batch in batches:
            rows, x = _matrix(batch.column(1), fit.scale, fit.offset, fit.dim)
            apart = _apart(x, fit)
            z = (apart / fit.n).astype(np.float64) @ matrix
            flat = pa.array(z.ravel(), from_pandas=True)  # NaN becomes null
            at = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(_deviation(apart), pa.int64()), pa.ListArray.from_arrays(at, flat)],
                names=["vec_id", "deviation", "z"])
    return run


def fit(vectors: DataFrame, components: int = 8, scale: float = 1024.0, offset: int = 100_000,
        vector_col: str = "embedding") -> Whitening | None:
    """Count, sums, covariance and leading components over all rows; None if no vector takes part (see :func:`whiten`)."""
    rows = ship(vectors).select(F.col(vector_col).alias("x"))
    sums = cut_lineage(rows.mapInArrow(_sums(scale, offset), "dim long, place long, n long, total long")
                       .groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sums")
    most = sums.filter("place = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return None
    got = sums.filter(F.col("dim") == most.dim).orderBy("place").collect()  # one row a dimension
    out = Whitening(most.n, np.array([r.total for r in got], np.int64), scale, offset)
    moments = rows.mapInArrow(_products(out), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros((out.dim, out.dim))
    for r in moments:  # dim * (dim + 1) / 2 rows, whatever the number of vectors
        cov[r.i, r.j] = cov[r.j, r.i] = r.v / out.n
    out.trace = float(np.trace(cov))
    out.values, out.vectors = leading_pairs(cov, components)
    return out


def project(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector that takes part: vec_id, deviation and z, its whitened coordinates."""
    return ship(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).mapInArrow(
        _projected(model), "vec_id long, deviation long, z array<double>")


def identity_error(projected: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of ``z`` minus the identity, over the components that have variance."""
    z = projected.select(*[F.col("z")[i].alias(f"z{i}") for i in range(components)])
    means = z.agg(*[F.avg(c).alias(c) for c in z.columns]).first()
    live = [i for i in range(components) if means[i] is not None]
    if not live:
        return None
    each = [((F.col(f"z{i}") - F.lit(means[i])) * (F.col(f"z{j}") - F.lit(means[j])), float(i == j)) for i in live for j in live if i <= j]
    got = z.agg(*[F.avg(v).alias(f"v{at}") for at, (v, _) in enumerate(each)]).first()
    return float(max(abs(v - want) for v, (_, want) in zip(got, each, strict=True)))


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024.0, offset: int = 100_000,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each vector and component (numbered from 1 by falling eigenvalue; all, if there are fewer dimensions):
    vec_id, component, n, deviation, whitened, explained, identity_error.

    Null vectors, empty ones and those holding null or non-finite entries (or entries that are 2^52 or more in size after
    scaling) take no part. Of vectors of several lengths only the most frequent length does (ties: the longer). Repeated rows and
    ids count as often as they come, each with its own result; a null id stays null. A deviation that does not fit a long
    is null. A component whose eigenvalue is zero to rounding (equal vectors, or fewer of them than dimensions) has null in
    ``whitened`` and takes no part in ``identity_error``; with no variance at all ``explained`` and ``identity_error`` are null. An
    empty table gives an empty result. Other columns are ignored."""
    spark = vectors.sparkSession
    model = fit(vectors, components, scale, offset, vector_col)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    rows = cut_lineage(project(vectors, model, id_col, vector_col), "whitened")
    error = identity_error(rows, len(model.values))
    share = F.array(*[F.lit(float(e) / model.trace if model.trace else None).cast("double") for e in model.values])
    return rows.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
