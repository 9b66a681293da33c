"""Nearest neighbours over embeddings: exact names first, then cosine by blocks of vectors.

``top_k`` compares everything with everything.  ``search`` finds the same rows
through an index: vectors are dealt to the nearest of some centres and, around
each, into shells.  A query first visits the blocks that may be best; then only
those whose bound can still beat what it has found.  For these, queries go in
groups, so that a block is sent once a group and not a query once a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import spaced
from ..sources.shared import TASKS_A_CORE, kept, spread
from .ordered import ranked

#: Vectors of a block: two blocks meet in one task as matrices.
BLOCK = 2048
#: Digits of a cosine: equal ones stay equal whatever the order in which a matrix product adds up, so ties go by id.
DIGITS = 9


def unit(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``df`` with the vectors as doubles of length one; a zero vector stays."""
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    once = F.array(F.struct(v.alias("v"), size.alias("size")))  # a lambda's variable, else the length is made again for each component
    return df.withColumn(vector, F.get(F.transform(once, lambda s: F.when(s["size"] > 0, F.transform(s["v"], lambda x: x / s["size"])).otherwise(s["v"])), F.lit(0)))


def exact(queries: DataFrame, index: DataFrame, typed: bool = True) -> DataFrame:
    """(qid, name, score 1.0): index names equal to the query's in normal form, of its type."""
    q = queries.select("qid", "type", spaced(F.col("name")).alias("_n"))
    i = index.select(F.col("name"), F.col("type").alias("_type"), spaced(F.col("name")).alias("_n")).distinct()
    on = [q["_n"] == i["_n"]] + ([q["type"] == i["_type"]] if typed else [])
    return q.join(i, on).select("qid", "name", F.lit(1.0).alias("score"))


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    one = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return one.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _apart(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """How far the rows of ``a`` are from those of ``b``: the angle between unit vectors, or the straight distance."""
    if metric == "angle":
        return np.arccos(np.clip(a @ b.T, -1.0, 1.0))
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += (a[:, i, None] - b[None, :, i]) ** 2
    return np.sqrt(out)


def _best(k: int, threshold: float, metric: str = "angle"):
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if len(left) and len(right):
            qid, ids = left.column("qid").to_numpy(), right.column("id").to_numpy()
            a, b = _matrix(left.column("vector")), _matrix(right.column("x_vector"))
            scores = np.round(a @ b.T, DIGITS) if metric == "angle" else -_apart(a, b, metric)
            # a row's k largest scores and what equals the last of them; only these are sorted
            least = np.partition(scores, -k, axis=1)[:, -k] if k < scores.shape[1] else np.full(len(scores), -np.inf)
            rows, cols = np.nonzero(scores >= np.maximum(least, threshold)[:, None])
            by = np.lexsort((ids[cols], -scores[rows, cols], rows))
            rows, cols = rows[by], cols[by]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            rows, cols = rows[nth < k], cols[nth < k]
            out = [qid[rows], ids[cols], scores[rows, cols]]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], schema=schema)

    return work


def top_k(queries: DataFrame, index: DataFrame, k: int = 5, threshold: float = 0.7) -> DataFrame:
    """(qid, id, score, rank): of each query (qid, type, vector) the ``k`` nearest index vectors (id, type, vector) of its type.

    Both sides are dealt into blocks within a type; every pair of blocks is one
    matrix product in one task, which returns its own ``k`` best only.  Vectors
    must have length one.  Scores are rounded to ``DIGITS`` digits; of equal
    ones the lesser id comes first.
    """
    n = lambda df: df.groupBy("type").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = n(queries).withColumnRenamed("blocks", "qb").join(n(index).withColumnRenamed("blocks", "ib"), "type")
    q = queries.join(sizes, "type").withColumn("i", F.pmod(F.xxhash64("qid"), F.col("qb")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ib") - 1)))
    x = index.join(sizes, "type").withColumn("j", F.pmod(F.xxhash64("id"), F.col("ib")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    q = q.select("type", "i", "j", F.col("qid").cast("long").alias("qid"), "vector")
    x = x.select(F.col("type").alias("x_type"), F.col("i").alias("x_i"), F.col("j").alias("x_j"), F.col("id").cast("long").alias("id"), F.col("vector").alias("x_vector"))
    met = q.groupBy("type", "i", "j").cogroup(x.groupBy("x_type", "x_i", "x_j")).applyInArrow(_best(k, threshold), "qid long, id long, score double")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", nth).filter(F.col("rank") <= k)


#: Centres of an index at most, besides one for each type, and the least size of a block.
CENTRES, SMALLEST = 1024, 64
#: Blocks that a query visits before it knows what it has to beat.
FIRST = 2
#: What rounding may take off a bound, beside its size.
SLACK = 1e-6
#: Queries of a group at least and at most, vectors that it is sent at once, about, and finds that it holds before it keeps the best.
GROUP, MOST, CHUNK, FINDS = 2048, 16_384, 65_536, 1_000_000
#: Queries whose distances to all centres a task makes at once.
SLICE = 1024


def _promising(gap: np.ndarray, to: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Per query (row) the blocks with the least gap, of equal ones the nearest centres: FIRST or as many as hold ``k`` vectors.  They are picked one by one, not sorted."""
    early = np.zeros(gap.shape, bool)
    rest, held, open_ = gap.copy(), np.zeros(len(gap), np.int64), np.arange(len(gap))
    for i in range(gap.shape[1]):
        least = rest[open_].min(1, keepdims=True)
        pick = np.where(rest[open_] == least, to[open_], np.inf).argmin(1)
        early[open_, pick], rest[open_, pick] = True, np.inf
        held[open_] += n[pick]
        open_ = open_[(held[open_] < k) | (i + 1 < FIRST)]
        if not len(open_):
            break
    return early


def _best_of(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each row, in order; of equal ones the lesser id."""
    by = np.lexsort((ids, -scores, row))
    nth = np.arange(len(by)) - np.searchsorted(row[by], row[by])
    return by[nth < k]


def _group_best(index: Index, k: int):
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64()), ("visited", pa.int64())])
    angle = index.metric == "angle"

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        t, qid = left.column("type")[0].as_py(), left.column("qid").to_numpy()
        a, bar = _matrix(left.column("vector")), left.column("least").to_numpy().copy()
        ids, x = right.column("id").to_numpy(), _matrix(right.column("x_vector"))
        wanted = np.concatenate([index._open(a[i : i + SLICE], t, k, bar[i : i + SLICE]) for i in range(0, len(a), SLICE)])
        place = {c: j for j, c in enumerate(zip(index.blocks[t]["centre"].tolist(), index.blocks[t]["shell"].tolist()))}
        of = np.array([place[c] for c in zip(right.column("x_centre").to_pylist(), right.column("x_shell").to_pylist())])
        order = np.argsort(of, kind="stable")
        blocks = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
        held, n = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], 0
        more: list[tuple] = []
        visited = np.zeros(len(a), np.int64)

        def best():
            row, found, scores = (np.concatenate([h, *v]) for h, v in zip(held, list(zip(*more)) or [()] * 3))
            keep = _best_of(row, found, scores, k)
            row, found, scores = row[keep], found[keep], scores[keep]
            full = np.flatnonzero(np.bincount(row, minlength=len(a)) >= k)
            last = np.searchsorted(row, full, "right") - 1
            bar[full] = np.maximum(bar[full], scores[last])
            return [row, found, scores]

        for own in blocks:
            rows = np.flatnonzero(wanted[:, of[own[0]]])
            visited[rows] += 1
            for some in np.split(rows, range(BLOCK, len(rows), BLOCK)):
                scores = a[some] @ x[own].T if angle else -_apart(a[some], x[own], index.metric)
                i, j = np.nonzero(scores >= (bar[some] - (10.0**-DIGITS if angle else 0.0))[:, None])
                scores = np.round(scores[i, j], DIGITS) if angle else scores[i, j]
                good = scores >= bar[some[i]]
                more.append((some[i[good]], ids[own[j[good]]], scores[good]))
                n += len(more[-1][0])
                if n >= FINDS:
                    held, more, n = best(), [], 0
        row, found, scores = best()
        none = lambda m, kind: pa.nulls(m, kind)
        hits = pa.table([pa.array(qid[row]), pa.array(found), pa.array(scores), none(len(row), pa.int64())], schema=schema)
        return pa.concat_tables([hits, pa.table([pa.array(qid), none(len(qid), pa.int64()), none(len(qid), pa.float64()), pa.array(visited)], schema=schema)])

    return work


class Index:
    """Vectors (id, type, vector) in blocks: shells around centres.

    ``metric`` is "angle" for vectors of length one, whose scores are cosines,
    or "euclidean", whose scores are distances below zero.  Rows without a type
    or with a null vector are left out; all vectors must be of one length.
    ``rows`` is a table of id, vector and block; ``blocks`` and ``centres`` are
    small.  With n vectors there are about the square root of n blocks of that
    many vectors, and at most half as many centres, so what is sent to all
    tasks grows with the root of n only.
    """

    def __init__(self, vectors: DataFrame, metric: str = "angle", seed: int = 1):
        self.metric = metric
        vectors = kept(spread(vectors.filter("type IS NOT NULL AND vector IS NOT NULL")).select(F.col("id").cast("long").alias("id"), "type", F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.monotonically_increasing_id().alias("row")), "vectors")
        self.source, n = vectors, vectors.count()
        self.size = max(SMALLEST, int(n**0.5))
        draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        some = vectors.filter(draw < min(CENTRES, n / self.size / 2) / max(n, 1)).select("type", "vector")
        each = vectors.groupBy("type").agg(F.min_by("vector", F.struct(draw, "id")).alias("vector"))  # of every type one at least
        found = some.unionByName(each).distinct().collect()
        self.centres: dict[str, np.ndarray] = {}
        for r in sorted(found, key=lambda r: (r["type"], r["vector"])):
            self.centres.setdefault(r["type"], []).append(r["vector"])
        self.centres = {t: np.array(v) for t, v in self.centres.items()}
        centres = self.centres

        def nearest(batches):
            for batch in (b for b in batches if len(b)):
                x, types = _matrix(batch.column("vector")), np.array(batch.column("type").to_pylist(), dtype=object)
                centre, away = np.zeros(len(batch), np.int32), np.zeros(len(batch))
                for t in set(types.tolist()):
                    own = np.flatnonzero([v == t for v in types])
                    a = _apart(x[own], centres[t], metric)
                    centre[own], away[own] = a.argmin(1), a.min(1)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "row", "type", "vector")], pa.array(centre), pa.array(away)], names=["id", "row", "type", "vector", "centre", "away"])

        dealt = vectors.mapInArrow(nearest, "id long, row long, type string, vector array<double>, centre int, away double")
        dealt = ranked(kept(dealt, "dealt"), ["type", "centre"], ["away", "id", "row"], "nth")
        self.rows = kept(dealt.withColumn("shell", F.floor((F.col("nth") - 1) / self.size).cast("int")).drop("nth", "row"), "index")
        shells = self.rows.groupBy("type", "centre", "shell").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
        self.blocks: dict[str, dict[str, np.ndarray]] = {}
        for t in self.centres:
            own = sorted((r["centre"], r["shell"], r["lo"], r["hi"], r["n"]) for r in shells if r["type"] == t)
            self.blocks[t] = dict(zip(("centre", "shell", "lo", "hi", "n"), map(np.array, zip(*own))))

    def _gaps(self, x: np.ndarray, type: str, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query (row) the least distance to a vector of each block of a type, and whether the block is one of the most promising."""
        b = self.blocks[type]
        to = _apart(x, self.centres[type], self.metric)[:, b["centre"]]
        gap = np.maximum(0.0, np.maximum(to - b["hi"], b["lo"] - to)) * (1 - SLACK) - SLACK
        return gap, _promising(gap, to, b["n"], k)

    def _open(self, x: np.ndarray, type: str, k: int, least: np.ndarray) -> np.ndarray:
        """Which blocks of a type, besides the most promising, may hold a score of ``least`` or more, for each query (row)."""
        bar = np.arccos(np.clip(least - 10.0**-DIGITS, -1.0, 1.0)) if self.metric == "angle" else -least
        gap, early = self._gaps(x, type, k)
        return ~early & (gap <= bar[:, None])

    def _bare(self) -> Index:
        """The index without its tables, for tasks."""
        bare = object.__new__(Index)
        bare.metric, bare.centres, bare.blocks = self.metric, self.centres, self.blocks
        return bare

    def first_visits(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, type, vector, centre, shell) for the most promising blocks of each query (qid, type, vector): FIRST or as many as hold ``k`` vectors."""
        index = self._bare()

        def plan(batches):
            for batch in (b for b in batches if len(b)):
                x, types = _matrix(batch.column("vector")), batch.column("type").to_pylist()
                for t in sorted(set(types) & set(index.centres)):
                    own, b = np.array([i for i, v in enumerate(types) if v == t]), index.blocks[t]
                    for some in np.split(own, range(SLICE, len(own), SLICE)):
                        i, j = np.nonzero(index._gaps(x[some], t, k)[1])
                        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(some[i])) for c in ("qid", "type", "vector")], pa.array(b["centre"][j], pa.int32()), pa.array(b["shell"][j], pa.int32())], names=["qid", "type", "vector", "centre", "shell"])

        return queries.select("qid", "type", "vector").mapInArrow(plan, "qid long, type string, vector array<double>, centre int, shell int")

    def grouped(self, queries: DataFrame) -> DataFrame:
        """``queries`` (qid, type, vector, least) of known types with a group: those around one or more centres of a type, from GROUP to MOST of them, about; crowded centres have several."""
        index, known = self._bare(), list(self.centres)

        def home(batches):
            for batch in (b for b in batches if len(b)):
                x, types, centre = _matrix(batch.column("vector")), batch.column("type").to_pylist(), np.zeros(len(batch), np.int32)
                for t in set(types):
                    own = np.array([i for i, v in enumerate(types) if v == t])
                    for some in np.split(own, range(SLICE, len(own), SLICE)):
                        centre[some] = _apart(x[some], index.centres[t], index.metric).argmin(1)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("qid", "type", "vector", "least")], pa.array(centre)], names=["qid", "type", "vector", "least", "home"])

        asked = kept(queries.filter(F.col("type").isin(known)).select("qid", "type", "vector", "least").mapInArrow(home, "qid long, type string, vector array<double>, least double, home int"), "asked")
        n = sorted(tuple(r) for r in asked.groupBy("type", "home").count().collect())  # a row per centre
        size = min(MOST, max(GROUP, sum(c for _, _, c in n) // (TASKS_A_CORE * asked.sparkSession.sparkContext.defaultParallelism)))
        first, held, of, rows = -1, size, None, []
        for t, home_, c in n:
            parts = -(-c // size)
            if parts > 1 or t != of or held + c > size:
                first, held, of = first + 1, 0, t
            rows.append((t, home_, first, parts))
            held += c
            if parts > 1:
                first, held = first + parts - 1, size
        at = asked.sparkSession.createDataFrame(rows, "type string, home int, first int, parts int")
        return asked.join(F.broadcast(at), ["type", "home"]).select("qid", "type", "vector", "least", (F.col("first") + F.pmod(F.xxhash64("qid"), F.col("parts"))).cast("int").alias("group"))

    def searched(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score) of the vectors in blocks that were not among a query's first and may hold a score of its ``least`` or more; of each query the ``k`` best of a chunk.

        A row without id has the number of blocks visited in ``visited``.  A
        task gets a group of queries and about CHUNK vectors at a time, and
        compares a block with those queries alone that must look into it.
        """
        index = self._bare()
        chunk = {t: np.cumsum(b["n"]) // CHUNK for t, b in self.blocks.items()}
        groups = kept(self.grouped(queries), "groups")

        def union(batches):
            for batch in (b for b in batches if len(b)):
                x, types, least, group = _matrix(batch.column("vector")), batch.column("type").to_pylist(), batch.column("least").to_numpy(), batch.column("group").to_numpy()
                for t in sorted(set(types)):
                    own, b = np.array([i for i, v in enumerate(types) if v == t]), index.blocks[t]
                    for some in np.split(own, range(SLICE, len(own), SLICE)):
                        wanted = index._open(x[some], t, k, least[some])
                        for g in np.unique(group[some]):
                            j = np.flatnonzero(wanted[group[some] == g].any(0))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), g), pa.int32()), pa.array([t] * len(j), pa.string()), *[pa.array(v[j], pa.int32()) for v in (b["centre"], b["shell"], chunk[t])]], names=["group", "type", "centre", "shell", "chunk"])

        wanted = kept(groups.mapInArrow(union, "group int, type string, centre int, shell int, chunk int").distinct(), "visits")
        q = groups.join(wanted.select("group", "chunk").distinct(), "group")
        x = self.rows.join(wanted, ["type", "centre", "shell"]).select(F.col("group").alias("x_group"), F.col("chunk").alias("x_chunk"), F.col("centre").alias("x_centre"), F.col("shell").alias("x_shell"), "id", F.col("vector").alias("x_vector"))
        return q.groupBy("group", "chunk").cogroup(x.groupBy("x_group", "x_chunk")).applyInArrow(_group_best(index, k), "qid long, id long, score double, visited long")

    def looked(self, visits: DataFrame, k: int, threshold: float) -> DataFrame:
        """(qid, id, score): the ``k`` best of each visited block; the queries of a block that many visit are dealt out."""
        at = ["type", "centre", "shell"]
        parts = visits.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
        q = visits.join(parts, at).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).drop("parts")
        x = self.rows.join(parts, at).withColumn("x_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        x = x.select(*[F.col(c).alias(f"x_{c}") for c in at], "x_part", "id", F.col("vector").alias("x_vector"))
        return q.groupBy(*at, "part").cogroup(x.groupBy(*[f"x_{c}" for c in at], "x_part")).applyInArrow(_best(k, threshold, self.metric), "qid long, id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int = 5, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """What ``top_k`` gives, and (qid, visited, blocks): how many of the blocks of its type each query visited; qid must be unique.

    Exact: a block is left out only if no vector in it can reach the k-th score
    that a query has found already, or the threshold.
    """
    q = kept(spread(queries.select(F.col("qid").cast("long").alias("qid"), "type", F.transform("vector", lambda x: x.cast("double")).alias("vector"))), "queries")
    first = kept(index.first_visits(q, k), "first-visits")
    early = kept(index.looked(first, k, threshold), "early")
    seen = kept(first.groupBy("qid").agg(F.count(F.lit(1)).alias("visited")), "seen", after=[first])
    least = _top(early, k).groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    late = kept(index.searched(q.join(least, "qid", "left").withColumn("least", F.coalesce("kth", F.lit(float(threshold)))), k), "late")
    out = _top(early.unionByName(late.filter("id IS NOT NULL").select("qid", "id", "score")), k)
    made = seen.unionByName(late.filter("id IS NULL").select("qid", "visited")).groupBy("qid").agg(F.sum("visited").alias("visited"))
    sizes = F.create_map(*[F.lit(v) for t, b in index.blocks.items() for v in (t, len(b["centre"]))]) if index.blocks else F.create_map().cast("map<string,int>")
    return out, q.select("qid", "type").join(made, "qid", "left").select("qid", F.coalesce("visited", F.lit(0)).alias("visited"), F.coalesce(F.try_element_at(sizes, F.col("type")), F.lit(0)).alias("blocks"))


def retrieve(queries: DataFrame, index: DataFrame, k: int = 10, threshold: float = 0.7) -> DataFrame:
    """(qid, name, score, rank): exact names alone where there are any, else the nearest vectors with each name once."""
    hits = exact(queries, index)
    nth = Window.partitionBy("qid").orderBy(F.desc("score"), "name")
    first = hits.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
    rest = queries.join(hits.select("qid").distinct(), "qid", "left_anti")
    near = search(rest.select("qid", "type", "vector"), Index(index.select("id", "type", "vector")), 2 * k, threshold)[0].drop("rank")
    named = near.join(index.select("id", "name"), "id").groupBy("qid", "name").agg(F.max("score").alias("score"))
    named = named.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
    return first.select("qid", "name", "score", "rank").unionByName(named.select("qid", "name", "score", "rank"))


def entity_names(*sources: tuple[DataFrame, str, str]) -> DataFrame:
    """(name, type): distinct trimmed names of several tables, each given with a column and a type; blanks and NA are none."""
    out = None
    for df, column, kind in sources:
        rows = df.select(F.trim(F.col(column).cast("string")).alias("name"), F.lit(kind).alias("type"))
        out = rows if out is None else out.unionByName(rows)
    return out.filter("name IS NOT NULL AND name NOT IN ('', 'NA')").distinct()


def neighbour_graph(points: DataFrame, k: int = 5) -> DataFrame:
    """(a, b, length): each point (id, type, vector) with its ``k`` nearest others of its type; of equal distances the lesser ids."""
    near = search(points.select(F.col("id").alias("qid"), "type", "vector"), Index(points, "euclidean"), k + 1, -float("inf"))[0].filter("qid != id")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", nth).filter(F.col("rank") <= k).select(F.col("qid").alias("a"), F.col("id").alias("b"), (-F.col("score")).alias("length"))
