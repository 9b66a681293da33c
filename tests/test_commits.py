"""Archives and result stores: what a writer that dies leaves, who wins, what is read."""

import os
import re

import pytest
from pyspark.sql import functions as F

from rankweave.sources import commits


def runs(spark, ids, value):
    return spark.createDataFrame([(r, i, value) for r in ids for i in range(4)], "run_id string, i int, value string")


def rows(df):
    return sorted(set((r["run_id"], r["value"]) for r in df.collect()))


def test_a_write_that_dies_leaves_the_old_runs_readable_and_is_resumed(spark, tmp_path):
    root = str(tmp_path / "archive")
    with pytest.raises(ValueError):
        commits.archived(spark, root, "candidates")
    assert commits.snapshot(spark, root).collect() == []
    assert commits.archive_runs(spark, root, {"candidates": runs(spark, ["a", "b/1", "007"], "old"), "meta": runs(spark, ["a", "b/1", "007"], "m1")}) == 1
    broken = runs(spark, ["a"], "m2").withColumn("i", F.when(F.col("i") > 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("i")))
    with pytest.raises(Exception, match="lost"):
        commits.archive_runs(spark, root, {"candidates": runs(spark, ["a", "c"], "new"), "meta": broken}, token="second")
    assert rows(commits.archived(spark, root, "candidates")) == [("007", "old"), ("a", "old"), ("b/1", "old")]
    assert rows(commits.archived(spark, root, "meta")) == [("007", "m1"), ("a", "m1"), ("b/1", "m1")]
    done = f"{root}/data/second/candidates/_SUCCESS"
    before = os.stat(done).st_mtime_ns
    assert commits.archive_runs(spark, root, {"candidates": runs(spark, ["a", "c"], "new"), "meta": runs(spark, ["a"], "m2")}, token="second") == 2
    assert os.stat(done).st_mtime_ns == before  # the table that was whole isn't written again
    live = commits.archived(spark, root, "candidates")
    assert rows(live) == [("007", "old"), ("a", "new"), ("b/1", "old"), ("c", "new")] and live.count() == 16 and live.columns == ["run_id", "i", "value"]
    assert rows(commits.archived(spark, root, "meta")) == [("007", "m1"), ("a", "m2"), ("b/1", "m1")]
    assert rows(commits.archived(spark, root, "candidates", commit=1)) == [("007", "old"), ("a", "old"), ("b/1", "old")]
    counts = {(r["run_id"], r["name"]): (r["n"], r["commit"]) for r in commits.snapshot(spark, root).collect()}
    assert counts[("a", "meta")] == (4, 2) and counts[("b/1", "candidates")] == (4, 1) and len(counts) == 7


def test_stale_folders_go_and_live_ones_stay(spark, tmp_path):
    root = str(tmp_path / "archive")
    for k, ids in enumerate((["a", "b"], ["b"], ["a", "b"]), 1):
        commits.archive_runs(spark, root, {"t": runs(spark, ids, f"v{k}")}, token=f"t{k}")
    spark.range(1).write.parquet(f"{root}/data/left/t")  # of an attempt that died
    assert commits.remove_stale(spark, root, keep=3) == 0
    assert commits.remove_stale(spark, root, keep=2) == 1 and os.path.exists(f"{root}/data/t1/t")  # b of the first commit
    assert rows(commits.archived(spark, root, "t", commit=2)) == [("a", "v1"), ("b", "v2")]
    assert commits.remove_stale(spark, root, idle_s=0) == 3 and sorted(os.listdir(f"{root}/data")) == ["t3"]
    assert rows(commits.archived(spark, root, "t")) == [("a", "v3"), ("b", "v3")]


def test_many_runs_share_few_folders_and_stale_ones_go_from_them(spark, tmp_path):
    root = str(tmp_path / "archive")
    folders = lambda token: [f for f in os.listdir(f"{root}/data/{token}/t") if f.startswith(commits.FOLDER)]
    on_disk = lambda: sum(spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data/{t}/t").count() for t in os.listdir(f"{root}/data"))
    ids = [f"r{i}" for i in range(300)]
    want, n = dict.fromkeys(ids, "v1"), len(ids) * 4
    commits.archive_runs(spark, root, {"t": runs(spark, ids, "v1")}, token="t1")
    assert len(folders("t1")) <= commits.BUCKETS
    for k, again in ((2, ids[::3]), (3, ids[::5])):
        commits.archive_runs(spark, root, {"t": runs(spark, again, f"v{k}")}, token=f"t{k}")
        before = dict(want)
        want |= dict.fromkeys(again, f"v{k}")
        commits.remove_stale(spark, root, keep=2)
        assert rows(commits.archived(spark, root, "t", commit=k - 1)) == sorted(before.items())
        commits.remove_stale(spark, root)
        assert rows(commits.archived(spark, root, "t")) == sorted(want.items()) and commits.archived(spark, root, "t").count() == n
        assert on_disk() == n  # nothing stale is left, and nothing is there twice
    counts = {r["run_id"]: r["commit"] for r in commits.snapshot(spark, root).collect()}
    assert counts == {r: int(v[1:]) for r, v in want.items()}
    assert commits.remove_stale(spark, root) == 0


def test_two_writers_never_share_a_number(spark, tmp_path):
    where = commits.Folder(spark, str(tmp_path))
    for name in ("s1", "s2"):
        spark.range(1).write.parquet(f"{tmp_path}/{name}")
    assert where.publish("s1", "log/commit=1") and not where.publish("s2", "log/commit=1")
    assert where.publish_next("s2", "log/commit=") == 2
    with pytest.raises(Exception):
        where.publish("missing", "log/commit=9")
    plain = commits.Folder(spark, f"file://{tmp_path}")
    assert set(plain.names("log")) == {"commit=1", f"commit={2:012d}"}


def test_results_are_computed_once_and_the_latest_counts(spark, tmp_path):
    path, asked = str(tmp_path / "results"), []
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")

    def compute(run):
        def work(wanted):
            asked.append(sorted(r["key"] for r in wanted.collect()))
            return wanted.filter("key != 'fails'").select("key", F.length("key").alias("n"), F.lit(run).alias("run"))

        return work

    assert commits.stored(spark, path) is None
    assert commits.results_of(keys(), path, compute(0)).collect() == [] and commits.stored(spark, path) is None
    first = commits.results_of(keys("a", "bb", "bb", "fails"), path, compute(1))
    assert sorted(tuple(r) for r in first.collect()) == [("a", 1, 1), ("bb", 2, 1)]
    second = commits.results_of(keys("bb", "ccc", "fails"), path, compute(2))
    assert sorted(tuple(r) for r in second.collect()) == [("bb", 2, 1), ("ccc", 3, 2)]
    assert [a for a in asked if a] == [["a", "bb", "fails"], ["ccc", "fails"]]
    commits.add_results(spark.createDataFrame([("a", 9, 3)], "key string, n int, run int"), path)
    want = [("a", 9, 3), ("bb", 2, 1), ("ccc", 3, 2)]
    assert sorted(tuple(r) for r in commits.stored(spark, path).collect()) == want
    commits.compact(spark, path)
    assert os.listdir(f"{path}/kind=added") == [] and len(os.listdir(f"{path}/kind=whole")) == 1
    assert sorted(tuple(r) for r in commits.stored(spark, path).collect()) == want
    commits.add_results(spark.createDataFrame([("bb", 5, 4)], "key string, n int, run int"), path)
    assert sorted(tuple(r) for r in commits.stored(spark, path, keys("bb")).collect()) == [("bb", 5, 4)]
    plan = commits.stored(spark, path, keys("bb"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_tables_of_earlier_rounds_are_deleted_and_others_stay(spark, tmp_path):
    from rankweave.sources.shared import kept, release

    files = lambda df: df.inputFiles()
    there = lambda f: os.path.exists(f.removeprefix("file:").replace("///", "/"))
    one = kept(spark.range(10), "one")
    old = files(one)
    two = kept(one.filter("id > 3"), "two", after=[one])
    assert two.count() == 6 and old and not any(map(there, old)) and all(map(there, files(two)))
    spark.range(3).write.parquet(str(tmp_path / "own"))
    own = spark.read.parquet(str(tmp_path / "own"))
    release(own)  # a user's table is none of kept's
    assert own.count() == 3
