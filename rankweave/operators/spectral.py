"""Principal components of wide matrices in long form: a row per entry, the longer side never gathered.

Where the shorter side has at most NARROW names, the driver holds directions
over that side alone, and a round is one pass over the entries; else neither
side is gathered, and a round joins the entries twice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Columns that a block has beyond those asked for, and blocks that the basis holds before it is cut back.
SPARE, BLOCKS = 8, 8
#: Names of a side whose directions the driver may hold; columns that a block has beyond those asked for there, at most and at least, and blocks of its basis.
NARROW, NARROW_SPARE, NARROW_LEAST, NARROW_BLOCKS = 1 << 19, 30, 4, 16
#: Numbers of a basis there, and of its image, at most: longer sides have fewer columns.
HELD = 1 << 24
#: Entries that a task takes at once in a pass over them.
AT_ONCE = 1_000_000


@dataclass
class Components:
    """``scores``: (row, pc), ``loadings``: (column, pc); ``variances`` along the components, ``total`` over all directions, and the ``rounds`` it took."""

    scores: DataFrame
    loadings: DataFrame
    variances: list[float]
    total: float
    rounds: int


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy().reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    n, m = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(np.ascontiguousarray(x).ravel()))


def _block(batch: pa.RecordBatch, start: tuple, steps: Sequence[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The basis' part and the new block's: a combination of the basis, its image and the first directions, then freed from the basis and recombined by each step."""
    n = batch.num_rows
    v, w = (_matrix(batch, c) if c in batch.schema.names else np.zeros((n, 0)) for c in ("v", "w"))
    of_v, of_w, of_first = start
    r = v @ of_v + w @ of_w if of_first is None else _matrix(batch, "first")
    for back, turn in steps:
        r = (r - v @ back) @ turn
    return v, r


def _gram(state: DataFrame, of) -> np.ndarray:
    """Products of all pairs of columns of ``of(batch)``, added up over the table; the driver gets one number per pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = of(batch)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "g"])

    found = state.mapInArrow(work, "at long, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(len(found))
    for at, g in found:
        out[at] = g
    m = int(round(len(found) ** 0.5))
    return out.reshape(m, m)


def _turn(gram: np.ndarray, m: int, least: float, scaled: bool) -> tuple:
    """The step that frees a block from a basis of ``m`` columns and makes it orthonormal, by the products of both; directions without length go."""
    back = gram[:m, m:]
    inner = gram[m:, m:] - back.T @ back
    length = np.sqrt(np.maximum(np.diag(inner), 0))
    some = np.flatnonzero(length > least)
    pick = np.zeros((len(length), len(some)))
    pick[some, np.arange(len(some))] = 1 / length[some] if scaled else 1.0
    size, side = np.linalg.eigh(pick.T @ inner @ pick)
    good = size > 1e-8
    return back, pick @ side[:, good] / np.sqrt(size[good])


def _images(entries: DataFrame, vectors: DataFrame, block: str, width: int, row: str, column: str) -> DataFrame:
    """A centred matrix times the columns of ``block``: (row, y)."""
    shift = vectors.agg(F.array(*[F.sum(F.col("mean") * F.get(block, F.lit(j))) for j in range(width)]).alias("shift"))
    sums = [F.sum(F.col("value") * F.get(block, F.lit(j))).alias(f"y{j}") for j in range(width)]
    y = entries.join(vectors.select(column, block), column).groupBy(row).agg(*sums).crossJoin(F.broadcast(shift))  # one row
    return y.select(row, F.array(*[F.col(f"y{j}") - F.get("shift", F.lit(j)) for j in range(width)]).alias("y"))


def _applied(entries: DataFrame, vectors: DataFrame, block: str, width: int, row: str, column: str) -> DataFrame:
    """The centred matrix' transpose times the matrix times the columns of ``block``: (column, image).

    The images of rows add up to 0, so the second product needs no centring.
    """
    y = _images(entries, vectors, block, width, row, column)
    sums = [F.sum(F.col("value") * F.get("y", F.lit(j))).alias(f"w{j}") for j in range(width)]
    return entries.join(y, row).groupBy(column).agg(*sums).select(column, F.array(*[f"w{j}" for j in range(width)]).alias("image"))


def _signs(loadings: DataFrame, k: int, column: str) -> list[float]:
    """The sign of each component's largest loading, of equals that of the least column."""
    return list(loadings.agg(*[F.min_by(F.signum(F.get("pc", F.lit(j))), F.struct(-F.abs(F.get("pc", F.lit(j))), column)) for j in range(k)]).first())


def _signed(df: DataFrame, key: str, signs: Sequence[float], *more: str) -> DataFrame:
    return df.select(key, *more, F.array(*[F.get("pc", F.lit(j)) * s for j, s in enumerate(signs)]).alias("pc"))


def _passes(lists: DataFrame, size: int, u: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """A matrix times the images of ``u`` less ``shift``, both ways in one pass over its lists (at, value) along the longer side; ``size`` rows.

    A direction at a time: sums over lists one behind the other, and over names by counting, are many times as fast as over rows of a block.
    """
    width, flat = u.shape[1], np.ascontiguousarray(u.T)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, size))
        for at, x, starts in _parts(batches):
            lengths = np.diff(np.append(starts, len(at)))
            for j in range(width):
                y = np.add.reduceat(x * flat[j][at], starts) - shift[j]
                out[j] += np.bincount(at, x * np.repeat(y, lengths), minlength=size)
        some = np.flatnonzero(out.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(out[j, some]) for j in range(width)]], names=["at", *names])

    names = [f"y{j}" for j in range(width)]
    found = lists.select("at", "value").mapInArrow(work, "at long, " + ", ".join(f"{c} double" for c in names)).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out, at = np.zeros((size, width)), found.column("at").to_numpy()
    for j, c in enumerate(names):
        out[at, j] = found.column(c).to_numpy()
    return out


def _lists_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists of a batch: places, values and lengths."""
    at, x = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "value"))
    return at.astype(np.int64), x, batch.column("at").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The lists of a task, about AT_ONCE entries at a time: places, values and where each list starts.  No list is empty."""
    held, n = [], 0

    def joined():
        at, x, lengths = (np.concatenate(v) for v in zip(*held))
        return at, x, np.cumsum(lengths) - lengths

    for batch in batches:
        if batch.num_rows:
            held.append(_lists_of(batch))
            n += len(held[-1][0])
            if n >= AT_ONCE:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def _by_narrow_side(cells: DataFrame, k: int, row: str, column: str, n: int, by_row: bool, most_error: float, most_rounds: int) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """(scores, loadings, eigenvalues, rounds) with the directions over the shorter side, rows or columns, held by the driver.

    The entries lie in one list per name of the longer side; a pass sends a
    block of directions to the lists' tasks, which return sums per name of the
    shorter side.  What the best combinations leave unexplained joins the basis.
    Basis and image have HELD numbers at most each, whatever the side's length.
    """
    side, other = (row, column) if by_row else (column, row)
    ids = cells.groupBy(side).agg((F.sum("value") / n).alias("mean")).withColumn("at", F.row_number().over(Window.orderBy(side)) - 1)  # at most NARROW rows
    ids = kept(ids, "names")
    pair = F.collect_list(F.struct("at", "value")).alias("l")
    lists = kept(cells.join(ids.select(side, "at"), side).groupBy(other).agg(pair).select(other, F.col("l.at").alias("at"), F.col("l.value").alias("value")), "lists")
    mean = ids.orderBy("at").select("mean").toArrow().column("mean").to_numpy()
    size = len(mean)
    # rows' directions are centred themselves, columns' images by the means' image
    centred = (lambda x: x - x.mean(0)) if by_row else (lambda x: x)
    shifted = (lambda u: np.zeros(u.shape[1])) if by_row else (lambda u: mean @ u)
    columns = HELD // max(size, 1)
    block = min(k + NARROW_SPARE, max(k + NARROW_LEAST, columns // NARROW_BLOCKS), size)
    columns = min(NARROW_BLOCKS * block, max(columns, 3 * block))
    all_v, all_w = (np.zeros((size, columns), order="F") for _ in range(2))
    m, rounds = 0, 0
    theta, sides = np.zeros(0), np.zeros((0, 0))
    r = centred(np.random.default_rng(1).standard_normal((size, block)))
    least = 0.0
    while True:
        v, w = all_v[:, :m], all_w[:, :m]
        if m:
            h = v.T @ w
            theta, sides = np.linalg.eigh((h + h.T) / 2)
            theta, sides = theta[::-1], sides[:, ::-1]
            best = sides[:, :block]
            r = w @ best - v @ (best * theta[:block])
            if (np.linalg.norm(r, axis=0)[:k] <= most_error * max(theta[0], 0.0)).all():
                break
            least = 1e-13 * theta[0]
        for _ in range(2):  # twice, as the first leaves rounding errors
            r = centred(r - v @ (v.T @ r))
            length = np.linalg.norm(r, axis=0)
            r = r[:, length > least] / length[length > least]
            left, s, _ = np.linalg.svd(r, full_matrices=False) if r.shape[1] else (r, np.zeros(0), None)
            r, least = left[:, s > 1e-4], 0.5
        if not r.shape[1]:
            break
        if rounds == most_rounds:
            raise RuntimeError("components did not settle")
        rounds += 1
        if m and m + r.shape[1] > columns:
            cut = sides[:, : 2 * block]
            m = cut.shape[1]
            all_v[:, :m], all_w[:, :m] = v @ cut, w @ cut
        width = r.shape[1]
        all_v[:, m : m + width], all_w[:, m : m + width] = r, centred(_passes(lists, size, r, shifted(r)))
        m += width

    k = min(k, len(theta), int((theta > 1e-12 * theta[0]).sum()) if len(theta) and theta[0] > 0 else 0)
    root = np.sqrt(theta[:k])
    u = v @ sides[:, :k] if k else np.zeros((size, 0))
    shift = shifted(u)
    kind = cells.schema[other].dataType.simpleString()

    def imaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, x, lengths = _lists_of(batch)
                y = np.zeros((len(lengths), k))
                for j in range(k):
                    y[:, j] = np.add.reduceat(x * u[at, j], np.cumsum(lengths) - lengths) - shift[j]
                yield pa.RecordBatch.from_arrays([batch.column(other), _lists(y / root if by_row else y)], names=[other, "pc"])

    far = kept(lists.mapInArrow(imaged, f"`{other}` {kind}, pc array<double>"), "images")
    own = cells.sparkSession.createDataFrame(pa.table({"at": pa.array(np.arange(size), pa.int32()), "pc": _lists(u * root if by_row else u)}))
    own = kept(ids.select(side, "at").join(own, "at").select(side, "pc"), "directions")
    return (own, far, theta[:k], rounds) if by_row else (far, own, theta[:k], rounds)


def components(df: DataFrame, k: int, row: str = "pair", column: str = "sample", value: str = "score", scaled: bool = False, most_error: float = 1e-7, most_rounds: int = 300) -> Components:
    """The first ``k`` principal components of rows over centred columns, which may be many; ``scaled`` divides columns by their deviation too.

    ``df`` has a row per entry; entries that are missing or null count as 0,
    repeated ones add up, entries without a row or column are none.  NaN and
    infinite values raise ValueError.  A block of random directions is multiplied
    by the matrix and its transpose; the parts of
    the images that the best combinations so far can't explain join the basis,
    until they are shorter than ``most_error`` of the greatest eigenvalue.  A
    basis of more than BLOCKS blocks is cut back to its best directions.  Where
    rows or columns are at most NARROW, the basis lies over these in the driver
    and a round is one pass over the entries, see ``_by_narrow_side``; else each
    round joins the entries twice, and the driver sees products of columns of
    the basis alone.  A component's sign makes its largest loading positive, of
    equals the one of the least column.  Of a matrix of lower rank only the
    components that exist are returned; an empty table has none.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    entries = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).select(F.col(row).alias("_row"), F.col(column).alias("_column"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value"))
    names, (row, column) = {"_row": row, "_column": column}, ("_row", "_column")  # so that no name clashes
    cells = kept(entries.groupBy(row, column).agg(F.sum("value").alias("value")), "cells")
    about = cells.agg(F.count_distinct(row).alias("n"), F.bool_or(F.isnan("value") | (F.abs("value") == float("inf"))).alias("odd")).first()
    n = about["n"]
    if about["odd"]:
        raise ValueError("values must be finite")
    if scaled:
        spread = cells.groupBy(column).agg(F.sqrt((F.sum(F.col("value") ** 2) - F.sum("value") ** 2 / n) / max(n - 1, 1)).alias("deviation"))
        cells = kept(cells.join(spread, column).select(row, column, F.when(F.col("deviation") > 0, F.col("value") / F.col("deviation")).otherwise(0.0).alias("value")), "scaled", after=[cells])
    of = cells.groupBy(column).agg((F.sum(F.col("value") ** 2) - F.sum("value") ** 2 / n).alias("v")).agg(F.count(F.lit(1)).alias("m"), F.sum("v").alias("total")).first()
    total = of["total"] or 0.0
    if n and min(n, of["m"]) <= NARROW:
        scores, loadings, theta, rounds = _by_narrow_side(cells, k, row, column, n, n <= of["m"], most_error, most_rounds)
        if len(theta):
            signs = _signs(loadings, len(theta), column)
            scores, loadings = (_signed(d, c, signs) for d, c in ((scores, row), (loadings, column)))
        return Components(scores.withColumnsRenamed(names), loadings.withColumnsRenamed(names), [float(x) / max(n - 1, 1) for x in theta], float(total) / max(n - 1, 1), rounds)
    kind = cells.schema[column].dataType.simpleString()

    block = k + SPARE
    first = [F.xxhash64(F.col(column), F.lit(j)) / float(2**63) for j in range(block)]
    state = kept(cells.groupBy(column).agg((F.sum("value") / max(n, 1)).alias("mean")).withColumn("first", F.array(*first)), "directions")
    m, rounds, sides, theta, start = 0, 0, None, np.zeros(0), (None, None, True)
    while n:
        steps: list[tuple] = []
        if m:
            g = _gram(state, lambda b: np.hstack([_matrix(b, "v"), _matrix(b, "w")]))
            h = g[:m, m:]
            theta, sides = np.linalg.eigh((h + h.T) / 2)
            theta, sides = theta[::-1], sides[:, ::-1]
            best = sides[:, :block]
            start = (-best * theta[:block], best, None)
        gram = _gram(state, lambda b, s=start: np.hstack(_block(b, s, [])))
        short = np.sqrt(np.maximum(np.diag(gram)[m:], 0))
        if m and (short[:k] <= most_error * max(theta[0], 0.0)).all():
            break
        steps.append(_turn(gram, m, 1e-13 * theta[0] if m else 0.0, True))
        if steps[0][1].shape[1]:
            steps.append(_turn(_gram(state, lambda b, s=start, t=tuple(steps): np.hstack(_block(b, s, t))), m, 0.5, False))
        width = steps[-1][1].shape[1]
        if not width:
            break
        if rounds == most_rounds:
            raise RuntimeError("components did not settle")
        rounds += 1
        cut = sides[:, : 2 * block] if m and m + width > BLOCKS * block else np.eye(m)

        def extended(batches: Iterator[pa.RecordBatch], s=start, t=tuple(steps), cut=cut) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v, r = _block(batch, s, t)
                    w = _matrix(batch, "w") @ cut if "w" in batch.schema.names else v
                    yield pa.RecordBatch.from_arrays([batch.column(column), batch.column("mean"), _lists(v @ cut), _lists(w), _lists(r)], names=[column, "mean", "v", "w", "r"])

        wider = kept(state.mapInArrow(extended, f"`{column}` {kind}, mean double, v array<double>, w array<double>, r array<double>"), "basis")
        images = _applied(cells, wider, "r", width, row, column)
        state = kept(wider.join(images, column).select(column, "mean", F.concat("v", "r").alias("v"), F.concat("w", "image").alias("w")), "basis", after=[wider, state])
        m = cut.shape[1] + width

    k = min(k, m, int((theta > 1e-12 * theta[0]).sum()) if m and theta[0] > 0 else 0)
    if not k:
        nothing = F.array().cast("array<double>").alias("pc")
        return Components(cells.select(row).distinct().select(row, nothing).withColumnsRenamed(names), state.select(column, nothing).withColumnsRenamed(names), [], total / max(n - 1, 1), rounds)

    def turned(batches: Iterator[pa.RecordBatch], best=sides[:, :k]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(column), batch.column("mean"), _lists(_matrix(batch, "v") @ best)], names=[column, "mean", "pc"])

    loadings = kept(state.mapInArrow(turned, f"`{column}` {kind}, mean double, pc array<double>"), "loadings")
    loadings = _signed(loadings, column, _signs(loadings, k, column), "mean")
    scores = _images(cells, loadings, "pc", k, row, column).withColumnRenamed("y", "pc")
    return Components(scores.withColumnsRenamed(names), loadings.select(column, "pc").withColumnsRenamed(names), [float(x) / max(n - 1, 1) for x in theta[:k]], float(total) / max(n - 1, 1), rounds)
