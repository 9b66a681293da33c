"""Bit-plane clustering, whitening and sharding against plain versions, with nulls, ties, repeats and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import bitplane, queries, sharding, whitening

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, cluster string, x int"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, "clash", 2) for i, v in rows], VECTORS.replace("double", kind)).repartition(3)


def hand_made(seed, n=300):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 2, (5, 64))
    rows = [(i, (centres[i % 5] + r.normal(0, 0.5, 64)).tolist()) for i in range(n)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[3][1]), (9000, [0.0] * 64), (9001, [-1000.5] * 64)]  # repeats, a null id, far ones
    bad = [(9100, None), (9101, []), (9102, [1.0] * 63), (9103, [None] + [1.0] * 63), (9104, [math.nan] + [1.0] * 63), (9105, [math.inf] + [1.0] * 63), (9106, [1.0] * 63 + [-math.inf])]
    return rows, bad


@pytest.mark.parametrize("bits", [1, 7, 28])
def test_popcounts_give_products_and_distances(bits):
    r = np.random.default_rng(bits)
    a, b = r.integers(0, 1 << bits, (50, 64)), r.integers(0, 1 << bits, (9, 64))
    pa_, pb = bitplane.planes_of(a, bits), bitplane.planes_of(b, bits)
    assert bitplane.dots(pa_, pb).astype(object).tolist() == [[int(sum(int(x) * int(y) for x, y in zip(u, v))) % 2**64 for v in b] for u in a]
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(u, v)) for v in b] for u in a]
    best, distance = bitplane.nearest(pa_, pb)
    assert distance.tolist() == [min(w) for w in want] and best.tolist() == [w.index(min(w)) for w in want]
    cluster = np.arange(50) % 3
    assert (bitplane.totals(pa_, cluster, 4) == np.stack([a[cluster == c].sum(0) for c in range(4)])).all()


def plain_clusters(rows, k=16, rounds=3):
    v = [(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), [math.floor(64 * c) for c in x], i) for i, x in rows]
    centroids = [x for _, x, _ in sorted(v, key=lambda t: t[:2])[:k]]

    def near(x):
        return min((sum((p - q) ** 2 for p, q in zip(x, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, x, _ in v:
            members[near(x)[1]].append(x)
        centroids = [[sum(col) // len(members[c]) for col in zip(*members[c])] if members[c] else old for c, old in enumerate(centroids)]
    found = [(i, *near(x)[::-1]) for _, x, i in v]
    return found, [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, seed):
    rows, bad = hand_made(seed)
    out = bitplane.clustered(frame(spark, rows + bad)).collect()
    want, digests = plain_clusters(rows)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in out) == Counter(want)
    inertia = Counter()
    for _, c, d in want:
        inertia[c] += d
    for r in out:
        assert (r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) == (inertia[r["cluster"]], sum(inertia.values()), digests[r["cluster"]])


def test_clusters_of_few_equal_or_no_vectors(spark):
    rows, bad = hand_made(3)
    assert bitplane.clustered(frame(spark, bad)).collect() == [] and bitplane.clustered(frame(spark, [])).collect() == []
    assert [(r["cluster"], r["distance"]) for r in bitplane.clustered(frame(spark, rows[:1])).collect()] == [(0, 0)]
    same = bitplane.clustered(frame(spark, [(i, [0.5] * 64) for i in range(30)])).collect()
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in same} == {(0, 0, 0)} and len(same) == 30
    with pytest.raises(ValueError):
        bitplane.clustered(frame(spark, [(1, [1e9] * 64), (2, [-1e9] * 64)]))
    one = [(i, [float(np.float32(x)) for x in v]) for i, v in rows[:60]]
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in bitplane.clustered(frame(spark, one, "float")).collect()) == Counter(plain_clusters(one)[0])


def spread(rows, dims):
    r = np.random.default_rng(rows)
    return r.normal(0, 1, (rows, dims)) @ np.diag(np.linspace(1, 0.1, dims)) + r.normal(0, 3, dims)


def test_triangle_and_rotations():
    for rank, dims in ((5, 5), (3, 7), (7, 8)):
        a = spread(rank, dims)
        a = a.T @ a
        factor, order = whitening.cholesky(a)
        assert factor.shape == (dims, rank) and np.allclose(factor @ factor.T, a[order][:, order]) and np.allclose(np.triu(factor, 1), 0)
        values, vectors = whitening.eigen(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
        assert np.allclose(a @ vectors, vectors * values, atol=1e-10 * values[0])
    graded = np.diag([1e12, 1.0, 1e-1]) + 1e-3
    assert np.allclose(np.sort(whitening.eigen(graded)[0]), np.linalg.eigvalsh(graded), rtol=1e-3)
    met = [(i, j) for a, b in whitening.pairings(7) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(met) == [(i, j) for i in range(7) for j in range(i + 1, 7)]


@pytest.mark.parametrize("size", [1, 1 << 20, 1 << 42])
def test_products_are_exact(size):
    y = np.random.default_rng(5).integers(-size, size + 1, (300, 4))
    plain = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(4)] for i in range(4)]
    assert whitening.products(y).tolist() == plain


@pytest.mark.parametrize("n,dims", [(200, 6), (500, 12), (4, 12), (5, 1)])
def test_whitening(spark, n, dims):
    rows = [(i if i else None, v.tolist()) for i, v in enumerate(spread(n, dims))] + [(2, spread(n, dims)[2].tolist())]
    bad = [(9000, None), (9001, [None] * dims), (9002, [math.nan] * dims), (9003, [math.inf] * dims), (9004, [1.0] * (dims + 1)), (9005, [])]
    out = whitening.whitened(frame(spark, rows + bad)).collect()
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    m, s = len(x), x.sum(0)
    centred = (m * x - s).astype(float) / m
    cov = centred.T @ centred / m
    values, vectors = np.linalg.eigh(cov)
    k = min(8, dims, m - 1, np.linalg.matrix_rank(cov, hermitian=True))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    want = centred @ vectors / np.sqrt(values)
    assert len(out) == k * m and {r["n"] for r in out} == {m}
    deviation = Counter((i, int(((m * row - s) ** 2).sum())) for (i, _), row in zip(rows, x))
    assert Counter((r["vec_id"], int(r["deviation"])) for r in out if r["component"] == 1) == deviation
    for c in range(k):
        mine = {r["vec_id"]: r["whitened"] for r in out if r["component"] == c + 1}
        plain = np.array([mine[i] for i, _ in rows])
        assert min(abs(plain - want[:, c]).max(), abs(plain + want[:, c]).max()) < 1e-7
        assert all(r["explained"] == pytest.approx(values[c] / cov.trace(), rel=1e-9) for r in out if r["component"] == c + 1)
    assert len({r["identity_error"] for r in out}) == 1 and out[0]["identity_error"] < 1e-9


def test_whitening_without_spread(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])]):
        assert whitening.whitened(frame(spark, rows)).collect() == []
    far = [(i, [1e8 * (i % 7), float(i % 3), 5.0]) for i in range(50)]  # sums of squares beyond a long, a constant dimension
    out = whitening.whitened(frame(spark, far)).collect()
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in far]
    s = [sum(c) for c in zip(*x)]
    assert {r["vec_id"]: int(r["deviation"]) for r in out} == {i: sum((50 * c - t) ** 2 for c, t in zip(v, s)) for i, v in enumerate(x)}
    assert {r["component"] for r in out} == {1, 2} and out[0]["identity_error"] < 1e-6


def plain_jump(key, n):
    k, b, j = int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16), -1, 0
    while j < n:
        b, k = j, (k * sharding.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((k >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 8, 32, 33, 500])
def test_jumps(spark, n):
    keys = [None, "", *map(str, range(400)), "ключ"]
    got = {r["k"]: r["s"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", sharding.shard_of(F.col("k"), n).alias("s")).collect()}
    assert got == {k: plain_jump(k, n) for k in keys}


DOCS = "doc_id long, text string, shard string, nth int, _at int, row string, law string"


def test_shards(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, "", "é", "same text", "x" * 20000, f"text {i}"])) for i in range(800)] + [(5, "hot")] * 700 + [(None, "t"), (None, None), (5, "other")]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2, "c", "d") for i, t in rows], DOCS).repartition(5)
    out = sharding.placed(docs).collect()
    size, crc = (lambda t: len((t or "").encode()) + 1), (lambda t: zlib.crc32((t or "").encode()))
    want, places = Counter(), defaultdict(list)
    for i, t in rows:
        places[plain_jump(i, 8)].append((i is not None, i or 0, size(t), crc(t), i))
    for s, members in places.items():
        for slot, (_, _, n, c, i) in enumerate(sorted(members, key=lambda m: m[:4])):
            want[i, n, c, "key", s, slot, plain_jump(i, 9)] += 1
    assert Counter(map(tuple, out)) == want
    assert sharding.placed(docs.limit(0)).collect() == []
    gone = sharding.moved(docs, 8, 9)
    assert gone.columns == docs.columns and Counter(r["doc_id"] for r in gone.collect()) == Counter(i for i, _ in rows if plain_jump(i, 9) == 8)


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t {i}", "clash", 1, 2, "c", "d") for i in range(300)], DOCS)
    name = sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "_shard" and set(back.columns) == {*docs.columns, name}
    assert {r["doc_id"]: r[name] for r in back.collect()} == {i: plain_jump(i, 4) for i in range(300)}


@pytest.mark.parametrize("name", ["op11_clusters", "op12_shards"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(want.columns).collect())) == Counter(want.fetchall())


def test_whitening_of_the_table(spark):
    out = queries.op13_whitening(spark, DATA).collect()
    n = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert len(out) == 8 * n and {r["n"] for r in out} == {n} and out[0]["identity_error"] < 1e-4
    w = np.array([r["whitened"] for r in sorted(out, key=lambda r: (r["vec_id"], r["component"]))]).reshape(n, 8)
    assert np.abs(w.T @ w / n - np.eye(8)).max() < 1e-9
