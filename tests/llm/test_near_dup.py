import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from rankweave.llm import near_dup


def shingles(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain(rows):
    """doc_id -> (class_id, n_links); ids are distinct."""
    sets = {i: shingles(t) for i, t in rows}
    links = defaultdict(set)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in ids:
        if i in out:
            continue
        todo, found = [i], {i}
        while todo:
            for j in links[todo.pop()] - found:
                found.add(j)
                todo.append(j)
        for j in found:
            out[j] = (min(found), len(links[j]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit("clash")).repartition(4)


def rows(seed=4):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out, i = [], 0
    for _ in range(40):  # families of near copies at all distances
        base = r.choices(words, k=r.randrange(8, 200))
        for _ in range(r.randrange(1, 5)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append((i, " ".join(w)))
            i += r.randrange(1, 9)
    hot = r.choices(words, k=120)
    for _ in range(300):  # more than two blocks of distinct near copies
        w = list(hot)
        w[r.randrange(len(w))] = r.choice(words)
        out.append((i, " ".join(w)))
        i += 1
    out += [(i + k, hot_copy) for k, hot_copy in enumerate([" ".join(hot)] * 5 + [" ".join(hot).upper().replace("W", "w"), None, "", " \n", "one two", "one  Two", "one", "x " * 8000, "X " * 9000])]
    return out


def test_against_all_pairs(spark):
    data = rows()
    want = plain(data)
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in near_dup.near_duplicates(frame(spark, data)).collect()}
    assert set(got) == set(want)
    lost = sum(want[i][1] - got[i][1] for i in want)
    assert all(got[i][1] <= want[i][1] for i in want)
    assert lost <= 0.01 * sum(n for _, n in want.values())
    assert sum(got[i][0] != want[i][0] for i in want) <= 0.01 * len(want)


def test_one_of_each_class_stays(spark):
    data = rows(8)
    out = near_dup.near_duplicates(frame(spark, data)).collect()
    kept = Counter(x["class_id"] for x in out if x["kept"])
    assert set(kept.values()) == {1} and set(kept) == {x["class_id"] for x in out}


def test_repeated_rows_null_ids_and_empty_table(spark):
    long = " ".join(f"a{i}" for i in range(40))
    data = [(5, long), (5, long), (5, long + " b"), (None, long), (None, "q r s"), (7, long), (8, "alone here")]
    out = near_dup.near_duplicates(frame(spark, data)).collect()
    assert len(out) == 7
    group = [x for x in out if x["n_links"]]
    assert len(group) == 5 and {x["class_id"] for x in group} == {5} and {x["n_links"] for x in group} == {4}
    assert sum(x["kept"] for x in group) == 1
    assert near_dup.near_duplicates(frame(spark, [])).collect() == []


def test_depths_are_shortened_until_the_recall_is_met():
    d = near_dup.matched_depth(0.8, 0.99)
    assert near_dup.chance_met(0.8, [d] * near_dup.TREES) >= 0.99 > near_dup.chance_met(0.8, [d + 1] * near_dup.TREES)
    full = [near_dup.DEPTH] * near_dup.TREES
    most = near_dup.shortened(full, {80: 1}, 0.8, 0.9995)
    assert near_dup.chance_met(0.8, most) >= 0.9995 and min(most) >= near_dup.matched_depth(0.8, 0.9995)
    # the threshold counts whatever was found, and a lower target takes longer prefixes
    assert all(near_dup.shortened(full, found, 0.8, 0.9995) == most for found in ({}, {97: 5}, {97: 5, 84: 1}))
    assert sum(near_dup.shortened(full, {97: 5}, 0.8, 0.9)) > sum(most)


def test_a_lone_pair_at_the_threshold_is_met_beside_close_ones():
    depths = near_dup.shortened([near_dup.DEPTH] * near_dup.TREES, {99: 5}, 0.8, 0.9995)
    r, lost = np.random.default_rng(8), 0
    for _ in range(4):
        sets = []
        for _ in range(500):  # 40 of 50 elements in common
            x = r.integers(0, 2**63, 50, dtype=np.uint64)
            sets += [np.sort(x[:45]), np.sort(np.concatenate([x[:40], x[45:]]))]
        signed = near_dup.signatures(sets)
        hashes = signed[:, : near_dup.HASH * near_dup.DEPTH * near_dup.TREES].reshape(len(sets), near_dup.TREES, near_dup.DEPTH, near_dup.HASH)
        same = (hashes[::2] == hashes[1::2]).all(3)
        met = np.any([same[:, t, :d].all(1) for t, d in enumerate(depths)], axis=0)
        at = np.arange(0, len(sets), 2)
        met &= near_dup.alike(signed[:, near_dup.HASH * near_dup.DEPTH * near_dup.TREES :], at, at + 1, near_dup.least_agreement(0.8))
        lost += int((~met).sum())
    assert lost <= 2


def test_a_lone_pair_beside_close_pairs_in_a_table(spark):
    docs = []
    for i in range(5):
        base = [f"c{i}_{k}" for k in range(600)]
        docs += [(10 * i, " ".join(base)), (10 * i + 1, " ".join([*base[:-1], "other"]))]
    for i in range(60):  # 40 of 50 shingles
        base = [f"p{i}_{k}" for k in range(49)]
        docs += [(1000 + 2 * i, " ".join(base)), (1001 + 2 * i, " ".join([*base[:44], *[f"q{i}_{k}" for k in range(5)]]))]
    got = {x["doc_id"]: x for x in near_dup.near_duplicates(frame(spark, docs)).collect()}
    assert all(x["n_links"] == 1 and x["class_id"] == i - i % 2 for i, x in got.items())


def test_runs_are_compared_as_all_pairs_are():
    r = np.random.default_rng(3)
    n, least = 200, near_dup.least_agreement(0.8)
    run = np.sort(r.integers(0, 30, n))
    kinds = r.integers(0, 256, (8, near_dup.SKETCH), np.uint8)
    sketch = kinds[r.integers(0, 8, n)]
    hashes = r.integers(0, 2, (n, near_dup.DEPTH)).astype(np.uint16)
    i, j = near_dup.pairs_in_runs(run, sketch, least)
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if run[a] == run[b] and (sketch[a] == sketch[b]).all()}
    assert set(zip(i.tolist(), j.tolist())) == want
    a, b, level = near_dup.joined(hashes, i, j, 2)
    for least_level in range(2, near_dup.DEPTH + 1):
        def classes(edges):
            label = list(range(n))
            for _ in range(n):
                for x, y in edges:
                    label[x] = label[y] = min(label[x], label[y])
            return label
        same = lambda x, y: next((k for k in range(near_dup.DEPTH) if hashes[x, k] != hashes[y, k]), near_dup.DEPTH)
        assert classes([(x, y) for x, y, k in zip(a.tolist(), b.tolist(), level.tolist()) if k >= least_level]) == classes([p for p in want if same(*p) >= least_level])


def test_components_of_long_paths(spark):
    n = 150
    edges = [(str(i).zfill(4), str(i + 1).zfill(4)) for i in range(n) if i % 50] + [("0003", "0003")]
    got = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[k] for k in got if k <= "0050"} == {"0001"}
    assert got["0100"] == "0051" and got["0150"] == "0101"


def test_components_that_are_stars_take_no_round_and_small_tables_few_tasks(spark, monkeypatch):
    names, put = [], near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, name: names.append((name, df.rdd.getNumPartitions())) or put(df, name))
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(40)] + [("a0", "c")], "a string, b string")
    got = {r["node"]: r["root"] for r in near_dup.components(pairs).collect()}
    assert [n for n, _ in names] == ["edges"] and got["b0"] == got["c"] == "a0" and len(got) == 81
    names.clear()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 99)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        path = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "4")], "a string, b string")
        assert {r["root"] for r in near_dup.components(path).collect()} == {"1"}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rounds = [n for name, n in names if name.endswith("-star")]
    assert rounds and max(rounds) <= 2 * spark.sparkContext.defaultParallelism


def test_a_run_longer_than_a_pass_compares(spark):
    r = random.Random(6)
    base = [f"h{k}" for k in range(60)]
    data = [(i, " ".join([*base[:58], f"x{i}"])) for i in range(700)] + [(700 + i, " ".join(r.choices(base, k=40))) for i in range(30)]
    got = {x["doc_id"]: x for x in near_dup.near_duplicates(frame(spark, data)).collect()}
    assert {got[i]["class_id"] for i in range(700)} == {0} and {got[i]["n_links"] for i in range(700)} == {699}
    assert all(got[i]["class_id"] == i for i in range(700, 730))


def test_columns_with_the_names_used_inside(spark):
    names = ["_key", "_h", "_nth", "key", "h", "slot", "sid", "root", "text_", "__KEY"]
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "z")], "doc_id long, text string")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names])
    out = near_dup.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(tuple(x) for x in docs.collect() if x["doc_id"] != 2)


def test_dropping(spark):
    long = " ".join(f"a{i}" for i in range(40))
    data = [(5, long), (5, long), (5, long + " b"), (None, long), (None, "q r s"), (7, long), (8, "alone here"), (9, None), (9, None)]
    out = near_dup.drop_near_duplicates(frame(spark, data))
    assert out.columns == ["doc_id", "text", "sid"]
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([next(x for x in [(5, long), (5, long + " b")] if x in {(r["doc_id"], r["text"]) for r in out.collect()}), (None, "q r s"), (8, "alone here"), (9, None), (9, None)])


def test_hardly_a_pair_at_the_threshold_is_lost(spark):
    r = random.Random(5)
    out = []
    for i in range(3000):  # pairs that no other text joins, at similarities 0.80 (40 of 50 shingles) to 0.88
        base = [f"p{i}_{k}" for k in range(49)]
        n = 44 + i % 3
        out += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:n] + [f"q{i}_{r.random()}" for _ in range(49 - n)]))]
    got = near_dup.near_duplicates(frame(spark, out)).collect()
    assert len(got) == 6000 and sum(x["n_links"] == 0 for x in got) <= 2 * 3
    assert {x["class_id"] % 2 for x in got if x["n_links"]} == {0}
