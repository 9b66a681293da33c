"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

1. Entries become integers, so that counts, sums and the scatter are exact
   however the rows are dealt over tasks.
2. The scatter is summed about an integer centre, the rounded mean, so
   that products stay small; the rest of the mean is taken off in integers.
   A task leaves one row per pair of dimensions.
3. On the driver - a matrix of the dimensions alone, whatever the rows - the
   covariance is factored with pivoting into a triangle.  Jacobi rotations make
   the triangle's columns orthogonal: their squared lengths are the
   eigenvalues, the columns themselves the components.
4. One pass projects the rows; another measures how far the projections'
   covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitplane import finite

#: Largest size of an entry after scaling: products of entries, summed over rows, stay within 38 digits.
LARGEST = 1 << 43
#: Bits of an entry that are multiplied at a time, and rows; their sums stay below 2^53, so that doubles are exact.
LIMB, ROWS = 21, 2048


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Matrices of doubles below 2^LIMB in size that add up to ``y``, the k-th counting 2^(LIMB k)."""
    out = []
    while True:
        low = (y & ((1 << LIMB) - 1)) if (np.abs(y) >> LIMB).any() else y
        out.append(low.astype(np.float64))
        if low is y:
            return out
        y = y >> LIMB


def products(y: np.ndarray) -> np.ndarray:
    """The exact y^T y as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), ROWS):
        parts = limbs(y[at : at + ROWS])
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total = total + ((a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)))
    return total


def cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L L^T: at each step the largest diagonal entry left goes first.

    L has as many columns as ``a`` has rank: what is left of a diagonal entry
    counts as nothing where it is rounding of that entry, however small beside others.
    """
    a, n = a.copy(), len(a)
    order, out = np.arange(n), np.zeros((n, n))
    rounding = 4 * n * np.finfo(float).eps * a.diagonal()
    for k in range(n):
        left = np.where(a.diagonal()[k:] > rounding[order[k:]], a.diagonal()[k:], 0.0)
        p = k + int(left.argmax())
        if left.max() == 0:
            return out[:, :k], order
        for m in (a, out):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        out[k, k] = a[k, k] ** 0.5
        out[k + 1 :, k] = a[k + 1 :, k] / out[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(out[k + 1 :, k], out[k + 1 :, k])
    return out, order


def pairings(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of 0 to n - 1 in which every pair occurs once."""
    m = n + n % 2
    ring, out = list(range(1, m)), []
    for _ in range(m - 1):
        line = [0, *ring]
        met = [(min(a, b), max(a, b)) for a, b in zip(line[: m // 2], reversed(line[m // 2 :])) if max(a, b) < n]
        if met:
            out.append(tuple(np.array(x) for x in zip(*met)))
        ring = ring[-1:] + ring[:-1]
    return out


def jacobi(w: np.ndarray, most_sweeps: int = 60) -> np.ndarray:
    """``w`` times a rotation, so that its columns are orthogonal to double precision; the longest comes first."""
    w = w.copy()
    rounds, small = pairings(w.shape[1]), np.finfo(float).eps * max(1, len(w)) ** 0.5
    for _ in range(most_sweeps):
        turned = False
        for i, j in rounds:
            a, b = w[:, i], w[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            need = np.abs(ab) > small * np.sqrt(aa * bb)
            if not need.any():
                continue
            turned = True
            i, j, a, b, aa, bb, ab = i[need], j[need], a[:, need], b[:, need], aa[need], bb[need], ab[need]
            z = (bb - aa) / (2 * ab)
            t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.hypot(1.0, t)
            w[:, i], w[:, j] = c * (a - t * b), c * (b + t * a)
        if not turned:
            break
    return w[:, np.argsort(-(w * w).sum(0), kind="stable")]


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above zero of a covariance, falling, and unit eigenvectors as columns."""
    factor, order = cholesky(v)
    turned = jacobi(factor)
    length = np.sqrt((turned * turned).sum(0))
    vectors = np.empty_like(turned)
    vectors[order] = turned / length
    return length**2, vectors


def _entries(part: pa.RecordBatch, scale: int, shift: int) -> np.ndarray:
    x = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale) + shift
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"entries must stay below {LARGEST} after scaling")
    return x.astype(np.int64).reshape(len(part), -1)


def _decimals(x: list[int]) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in x], pa.decimal128(38, 0))


def usual_length(rows: DataFrame) -> int:
    """The commonest length of the arrays ``v``, of equals the largest; 0 without rows."""
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def sums(rows: DataFrame, dims: int, scale: int, shift: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of each dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            n += len(batch)
            for at in range(0, len(batch), ROWS):
                total = total + _entries(batch.slice(at, ROWS), scale, shift).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), _decimals(total)], names=["i", "n", "total"])

    found = rows.mapInArrow(work, "i int, n long, total decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    total = {r["i"]: int(r["total"]) for r in found}
    return (found[0]["n"], [total[i] for i in range(dims)]) if found else (0, [])


def covariance(rows: DataFrame, n: int, total: list[int], scale: int, shift: int) -> tuple[np.ndarray, list[int]]:
    """The covariance with divisor ``n``, each entry the double next to the exact fraction; and the integer centre."""
    dims = len(total)
    centre = [(2 * s + n) // (2 * n) for s in total]
    about = np.array(centre, np.int64)
    i, j = np.triu_indices(dims)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter = np.zeros((dims, dims), object)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                scatter = scatter + products(_entries(batch.slice(at, ROWS), scale, shift) - about)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(scatter[i, j])], names=["i", "j", "total"])

    found = rows.mapInArrow(work, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()  # pairs of dimensions
    rest = [s - n * c for s, c in zip(total, centre)]
    v = np.empty((dims, dims))
    for r in found:
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = (n * int(r["total"]) - rest[r["i"]] * rest[r["j"]]) / (n * n)
    return v, centre


def deviations(y: np.ndarray, n: int, rest: np.ndarray) -> list[int]:
    """Exact sums over dimensions of (n x - S)^2 from x less its centre, whose sums are ``rest``."""
    size = max(int(np.abs(y).max(initial=0)), 1) * n + int(np.abs(rest).max(initial=0))
    if size * size * max(1, y.shape[1]) < 2**63:
        d = y * n - rest.astype(np.int64)
        return (d * d).sum(1).tolist()
    d = y.astype(object) * n - rest
    return (d * d).sum(1).tolist()


def whitened(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold a null, NaN or infinite entry are left out,
    and so are those that haven't the commonest length (of equally common ones
    the larger): they have no place in the covariance.  An entry c becomes
    x = floor(scale * c) + shift; ``shift`` changes nothing but x.  deviation is
    a decimal.  Components are numbered by falling eigenvalue from 1 and are as
    many as the covariance has rank, ``most`` at most: a single vector, or
    equal ones, have none and give no rows.  Repeated rows and null ids count
    like others.  Without vectors the result is empty.  Entries of 2^43 or more
    after scaling raise an error.  Other columns are ignored, whatever their
    names.  The driver gets a number per pair of dimensions.
    """
    vector = F.col(f"`{vector_col}`")
    rows = embeddings.filter(finite(vector)).select(F.col(f"`{id_col}`").alias("vec_id"), vector.alias("v"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    dims = usual_length(rows)
    rows = rows.filter(F.size("v") == dims)
    n, total = sums(rows.select("v"), dims, scale, shift) if dims else (0, [])
    if not n:
        return rows.sparkSession.createDataFrame([], shape)
    v, centre = covariance(rows.select("v"), n, total, scale, shift)
    values, vectors = eigen(v)
    values, vectors = values[:most], vectors[:, :most]
    if not len(values):
        return rows.sparkSession.createDataFrame([], shape)
    about, rest = np.array(centre, np.int64), np.array([s - n * c for s, c in zip(total, centre)], object)
    offset, project = rest.astype(np.float64) / n, vectors / np.sqrt(values)
    explained, k = values / v.trace(), len(values)

    def projected(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = _entries(part, scale, shift) - about
        return y, (y - offset) @ project

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                w = projected(batch.slice(at, ROWS))[1]
                first, second = first + w.sum(0), second + w.T @ w
        i, j = np.indices((k, k)).reshape(2, -1)
        i, j, t = [*i.tolist(), *range(k)], [*j.tolist(), *[-1] * k], [*second.ravel().tolist(), *first.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(t, pa.float64())], names=["i", "j", "total"])

    found = {(r["i"], r["j"]): r["total"] / n for r in rows.select("v").mapInArrow(moments, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    # the projections are centred already; what rounding left of their mean is taken off
    error = max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(k) for j in range(k))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                y, w = projected(part)
                m = len(part)
                each = np.repeat(np.arange(m), k)
                columns = [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64())]
                columns += [_decimals(deviations(y, n, rest)).take(pa.array(each)), pa.array(w.ravel(), pa.float64()), pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(work, shape)
