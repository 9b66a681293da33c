"""Centroid clustering of integer vectors by bit planes.

A vector's components are shifted so that none is negative, and cut into bits.
Bit p of all 64 components is one 64-bit word, the vector's plane p.  The dot
product of two vectors is then

    sum over p, q of 2^(p+q) * popcount(plane_p AND other_plane_q)

which is exact, and so is every squared distance.  Vectors are packed once;
each round is one pass over the planes in which a task leaves a count and sums
per centroid, whatever its rows are.  Only the centroids reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed_bytes, written

#: Components of a vector: one for each bit of a word.
WIDTH = 64
#: The widest range of a component at which every squared distance fits a signed 64-bit number.
WIDEST = int((2**63 / WIDTH) ** 0.5) - 1
#: Vectors that are worked on together.
ROWS = 4096


def finite(vector: Column) -> Column:
    """Whether an array is there and none of its entries is null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def planes_of(u: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes) words from (rows, 64) numbers that are not negative: bit i of plane p is bit p of component i."""
    return np.stack([np.packbits((u >> p & 1).astype(bool), axis=1, bitorder="little").view("<u8")[:, 0] for p in range(planes)], axis=1)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The dot products of all rows of ``a`` with all rows of ``b``, both as planes, modulo 2^64; planes without a bit cost nothing."""
    out = np.zeros((len(a), len(b)), np.uint64)
    for p in np.flatnonzero(a.any(0)):
        for q in np.flatnonzero(b.any(0)):
            out += np.bitwise_count(a[:, p, None] & b[None, :, q]).astype(np.uint64) << np.uint64(p + q)
    return out


def squares(a: np.ndarray) -> np.ndarray:
    """Each row's dot product with itself, modulo 2^64."""
    out = np.zeros(len(a), np.uint64)
    used = np.flatnonzero(a.any(0))
    for k, p in enumerate(used):
        out += np.bitwise_count(a[:, p]).astype(np.uint64) << np.uint64(2 * p)
        for q in used[:k]:
            out += np.bitwise_count(a[:, p] & a[:, q]).astype(np.uint64) << np.uint64(p + q + 1)
    return out


def nearest(a: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the first of equals, and the squared distance; wrapping sums are right, as the distance itself fits."""
    distance = (squares(a)[:, None] + squares(centroids)[None] - (dots(a, centroids) << np.uint64(1))).view(np.int64)
    best = distance.argmin(1)
    return best, distance[np.arange(len(a)), best]


def totals(a: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """(k, 64) sums of the components of each cluster's rows, from the planes' bits."""
    out = np.zeros((k, WIDTH), np.int64)
    member = (cluster[None] == np.arange(k)[:, None]).astype(np.float64)
    for p in np.flatnonzero(a.any(0)):
        bits = np.unpackbits(np.ascontiguousarray(a[:, p]).astype("<u8").view(np.uint8).reshape(len(a), 8), axis=1, bitorder="little")
        out += (member @ bits).astype(np.int64) << p  # counts of rows of a batch: exact
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def _words(part: pa.RecordBatch, planes: int) -> np.ndarray:
    return np.ascontiguousarray(fixed_bytes(part.column("planes"), 8 * planes)).view("<u8")


def packed(vectors: DataFrame, least: int, planes: int) -> DataFrame:
    """(vec_id, planes) from (vec_id, x): the bits of x - least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            u = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), WIDTH) - least
            words = np.ascontiguousarray(planes_of(u, planes).astype("<u8"))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([w.tobytes() for w in words], pa.binary())], names=["vec_id", "planes"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(work, f"vec_id {kind}, planes binary")


def moved(rows: DataFrame, centroids: list[list[int]], planes: int) -> list[list[int]]:
    """The centroids after one round: each the floor of its vectors' mean; one without vectors stays.

    A task leaves at most a row per centroid; so many come to the driver.
    """
    at = planes_of(np.array(centroids, np.int64), planes)
    k = len(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64)
        for part in _pieces(batches):
            words = _words(part, planes)
            cluster, _ = nearest(words, at)
            count += np.bincount(cluster, minlength=k)
            total += totals(words, cluster, k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    partial = rows.mapInArrow(work, "cluster int, n long, total array<long>")
    sums = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(WIDTH)])
    new = {r["cluster"]: [int(r[f"t{i}"]) // r["n"] for i in range(WIDTH)] for r in sums.collect()}
    return [new.get(c, old) for c, old in enumerate(centroids)]


def assigned(rows: DataFrame, centroids: list[list[int]], planes: int) -> DataFrame:
    """(vec_id, cluster, distance) of packed rows."""
    at = planes_of(np.array(centroids, np.int64), planes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            cluster, distance = nearest(_words(part, planes), at)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"vec_id {kind}, cluster int, distance long")


def clustered(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors without exactly 64 finite components are left out.  A component x
    becomes floor(scale * x).  The first centroids are the vectors with the
    least SHA-256 of ``seed:vec_id``, of equal ones the least vector; a null id
    counts as empty text.  Equal distances go to the smaller number.  Fewer
    vectors than ``k`` make fewer centroids; equal vectors may start several,
    of which the later stay empty and where they are.  Repeated rows count
    each.  Without vectors the result is empty.  Components that lie farther
    apart than 379 million after scaling raise an error: a squared distance
    might not fit a long.  Other columns are ignored, whatever their names.
    """
    vector = F.col(f"`{vector_col}`")
    rows = embeddings.filter((F.size(vector) == WIDTH) & finite(vector)).select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("x"))
    ends = rows.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi")).first()
    least, most = ends["lo"] or 0, ends["hi"] or 0
    if most - least > WIDEST:
        raise ValueError(f"components from {least} to {most}: a squared distance may not fit 64 bits")
    planes = max(1, int(most - least).bit_length())
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(draw.alias("draw"), "x").orderBy("draw", "x").limit(k).collect()
    centroids = [[x - least for x in r["x"]] for r in first]
    if not centroids:
        centroids = [[0] * WIDTH]  # of no vector

    bits = written(packed(rows, least, planes), "planes")
    for _ in range(rounds):
        centroids = moved(bits, centroids, planes)
    out = written(assigned(bits, centroids, planes), "clusters")
    sums = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows at most
    digests = [hashlib.sha256(",".join(str(x + least) for x in c).encode()).hexdigest() for c in centroids]
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1)
    sums = sums.crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia")))).withColumn("centroid_sha256", digest)
    return out.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
