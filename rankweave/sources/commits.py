"""Tables that appear whole or not at all: an archive of runs and a store of results.

Spark writes to a staged folder; one rename publishes it.  A rename never
replaces what is there, so of two writers that want the same number one takes
the next.  Everything goes through Hadoop's file systems, whatever the path is.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

DIGITS = 12
#: Folders that the runs of a table, or the keys of a store, are dealt into by a hash.
BUCKETS = 64


class Folder:
    """A folder in any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._fs = spark, path.rstrip("/"), spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        return self._fs.Path(f"{self.path}/{name}" if name else self.path)

    def _system(self):
        return self._at().getFileSystem(self._conf)

    def has(self, name: str = "") -> bool:
        return self._system().exists(self._at(name))

    def names(self, name: str = "") -> dict[str, float]:
        """The children's names with the seconds since they were changed; none if the folder isn't there."""
        return {f.getPath().getName(): time.time() - f.getModificationTime() / 1000 for f in self._system().listStatus(self._at(name))} if self.has(name) else {}

    def delete(self, name: str) -> None:
        self._system().delete(self._at(name), True)

    def publish(self, staged: str, to: str) -> bool:
        """Renames, and says whether it did; False if something has that name already."""
        self._system().mkdirs(self._at(to).getParent())
        options = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 1)
        options[0] = getattr(self._fs, "Options$Rename").NONE
        try:
            self._fs.FileContext.getFileContext(self._at().toUri() if ":" in self.path else self._system().getUri(), self._conf).rename(self._at(staged), self._at(to), options)
        except (Py4JJavaError, PySparkException) as e:
            if self.has(to) and self.has(staged):
                return False
            raise e
        return True

    def publish_next(self, staged: str, prefix: str, after: int = 0) -> int:
        """Publishes under ``prefix`` and the next free number above ``after``, which is returned."""
        parent, _, start = prefix.rpartition("/")
        while True:
            taken = [int(n.removeprefix(start)) for n in self.names(parent) if n.startswith(start) and n.removeprefix(start).isdigit()]
            number = max([after, *taken]) + 1
            if self.publish(staged, f"{prefix}{number:0{DIGITS}d}"):
                return number


# an archive of runs

#: The column that names the folder of a run's rows within a table's: runs share BUCKETS folders, whatever their number.
FOLDER = "_folder"
LOG = "run_id string, name string, token string, n long, commit long"
#: Tables that ``remove_stale`` wrote anew, as a whole in each entry of ``moved``: the attempt of the log and where its rows are now.
MOVED = "run_id string, name string, token string, to string"


def _write_folders(rows: DataFrame, path: str) -> None:
    rows.withColumn(FOLDER, _bucket(F.col("run_id").cast("string"))).hint("rebalance", FOLDER).write.mode("overwrite").partitionBy(FOLDER).parquet(path)


def _rows(spark: SparkSession, root: str, name: str, tokens: list[str]) -> DataFrame:
    """The rows of one table of some attempts, with _of, the attempt."""
    rows = spark.read.option("recursiveFileLookup", True).option("mergeSchema", len(tokens) > 1).parquet(*[f"{root}/data/{t}/{name}" for t in tokens])
    return rows.withColumn("_of", F.regexp_extract("_metadata.file_path", r"/data/([^/]+)/", 1))


def archive_runs(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], token: str | None = None) -> int:
    """Archives the runs in ``tables`` (each with a column run_id) together, and returns the commit's number.

    Until the last step nothing of it is visible.  A run that was archived
    before is replaced in all its tables, by those that are given now.
    ``token`` names the attempt: if one with the same token died, tables that
    it had written whole are taken as they are, so it must stand for the input.
    """
    where, token = Folder(spark, root), token or uuid.uuid4().hex
    entries = []
    for name, df in tables.items():
        at = f"data/{token}/{name}"
        if not where.has(f"{at}/_SUCCESS"):
            _write_folders(df, f"{root}/{at}")
        entries.append(spark.read.schema(df.schema).parquet(f"{root}/{at}").groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("n")).select("run_id", F.lit(name).alias("name"), F.lit(token).alias("token"), "n"))
    staged = f"staged/{token}"
    reduce(DataFrame.unionByName, entries).write.mode("overwrite").parquet(f"{root}/{staged}")
    return where.publish_next(staged, "log/commit=")


def _moves(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """The last entry of ``moved`` and its number."""
    last = max([int(n.removeprefix("seq=")) for n in Folder(spark, root).names("moved") if n.startswith("seq=")], default=0)
    return (spark.read.schema(MOVED).parquet(f"{root}/moved/seq={last:0{DIGITS}d}") if last else None), last


def _log(spark: SparkSession, root: str, moves: DataFrame | None) -> DataFrame:
    """The log, with ``origin``, the attempt as it was logged, and ``token``, the one that has the rows now."""
    log = spark.read.schema(LOG).parquet(f"{root}/log").withColumn("origin", F.col("token"))
    if moves is None:
        return log
    return log.join(moves.withColumnRenamed("token", "origin"), ["run_id", "name", "origin"], "left").withColumn("token", F.coalesce("to", "token")).drop("to")


def snapshot(spark: SparkSession, root: str, commit: int | None = None) -> DataFrame:
    """(run_id, name, token, n, commit): the tables of each run's last commit, or of the last one up to ``commit``."""
    if not Folder(spark, root).names("log"):
        return spark.createDataFrame([], LOG)
    return _shown(_log(spark, root, _moves(spark, root)[0]), commit).select("run_id", "name", "token", "n", "commit")


def _shown(log: DataFrame, commit: int | None) -> DataFrame:
    log = log if commit is None else log.filter(F.col("commit") <= commit)
    last = log.groupBy("run_id").agg(F.max("commit").alias("commit"))
    return log.join(last, ["run_id", "commit"], "left_semi")


def archived(spark: SparkSession, root: str, name: str, commit: int | None = None) -> DataFrame:
    """The rows of one table of all runs, each from its run's last commit; only attempts that such a run is of are read."""
    live = snapshot(spark, root, commit).filter(F.col("name") == name).select(F.col("run_id").alias("_run"), F.col("token").alias("_token"))
    tokens = [r["_token"] for r in live.select("_token").distinct().collect()]  # one per commit that is still live
    if not tokens:
        raise ValueError(f"no run has a table {name}")
    rows = _rows(spark, root, name, tokens)
    return rows.join(live, (F.col("run_id").cast("string") == F.col("_run")) & (F.col("_of") == F.col("_token")), "left_semi").drop("_of")


def remove_stale(spark: SparkSession, root: str, keep: int = 1, idle_s: float = 86_400) -> int:
    """Deletes what no one of the last ``keep`` snapshots shows and attempts that were left for ``idle_s``; returns how many folders went.

    A folder in which some runs are stale is replaced: its other runs are
    written anew, and one rename makes all readers look there.
    """
    where = Folder(spark, root)
    commits = sorted(int(n.removeprefix("commit=")) for n in where.names("log") if n.startswith("commit="))
    if not commits:
        return 0
    moves, last = _moves(spark, root)
    log = _log(spark, root, moves).withColumn(FOLDER, _bucket("run_id"))
    keys = ["run_id", "name", "token", "origin", FOLDER]
    kept = reduce(DataFrame.union, [_shown(log, c).select(keys) for c in commits[-keep:]]).distinct()
    folders = log.select(keys).distinct().join(kept.withColumn("live", F.lit(1)), keys, "left").groupBy("name", "token", FOLDER).agg(F.count("live").alias("live"), F.count(F.lit(1)).alias("n"))
    folders = folders.filter("live < n").collect()  # BUCKETS at most for a table of a commit
    stale, to = [(r["name"], r["token"], r[FOLDER]) for r in folders if not r["live"]], uuid.uuid4().hex
    if mixed := [(r["name"], r["token"], r[FOLDER]) for r in folders if r["live"]]:
        some = kept.join(F.broadcast(spark.createDataFrame(mixed, f"name string, token string, {FOLDER} int")), ["name", "token", FOLDER])
        for name in sorted({m[0] for m in mixed}):
            wanted = some.filter(F.col("name") == name).select(F.col("run_id").alias("_run"), F.col("token").alias("_token"))
            rows = _rows(spark, root, name, sorted({m[1] for m in mixed if m[0] == name}))
            rows = rows.join(wanted, (F.col("run_id").cast("string") == F.col("_run")) & (F.col("_of") == F.col("_token")), "left_semi")
            _write_folders(rows.drop("_of"), f"{root}/data/{to}/{name}")
        now = some.select("run_id", "name", F.col("origin").alias("token"), F.lit(to).alias("to"))
        if moves is not None:
            now = now.unionByName(moves.join(kept.select("run_id", "name", F.col("origin").alias("token")), ["run_id", "name", "token"], "left_semi").join(now.select("run_id", "name", "token"), ["run_id", "name", "token"], "left_anti"))
        now.write.parquet(f"{root}/staged/{to}")
        if where.publish(f"staged/{to}", f"moved/seq={last + 1:0{DIGITS}d}"):
            stale += mixed
        else:  # another did so at the same time, and its folders count
            for left in (f"staged/{to}", f"data/{to}"):
                where.delete(left)
            return 0
    gone = 0
    live = {r["token"] for r in _log(spark, root, _moves(spark, root)[0]).join(kept.select("run_id", "name", "origin"), ["run_id", "name", "origin"], "left_semi").select("token").distinct().collect()}
    known = {r["token"] for r in log.select("token").union(log.select("origin")).distinct().collect()}
    for name, token, folder in stale:
        if token in live and where.has(old := f"data/{token}/{name}/{FOLDER}={folder}"):
            where.delete(old)
            gone += 1
    for token, idle in where.names("data").items():
        if token not in live and (token in known or idle >= idle_s):
            where.delete(f"data/{token}")
            gone += 1
    return gone


# a store of results by key

def _bucket(key: str | Column = "key") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _segments(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The folders that count: the last compacted one and what was added after it; and the last number."""
    where = Folder(spark, path)
    numbers = lambda kind: sorted(int(n.removeprefix("seq=")) for n in where.names(f"kind={kind}") if n.startswith("seq="))
    whole, added = numbers("whole")[-1:], numbers("added")
    after = [n for n in added if not whole or n > whole[0]]
    named = [("whole", n) for n in whole] + [("added", n) for n in after]
    return [f"{path}/kind={k}/seq={n:0{DIGITS}d}" for k, n in named], max([*whole, *added], default=0)


def add_results(results: DataFrame, path: str) -> int | None:
    """Adds rows (key, ...) to the store at ``path``; rows with the same key later in time win.  Without rows nothing is added."""
    spark, staged = results.sparkSession, f"staged/{uuid.uuid4().hex}"
    rows = results.withColumn("bucket", _bucket())
    rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{staged}")
    where = Folder(spark, path)
    if not any(n.startswith("bucket=") for n in where.names(staged)):
        where.delete(staged)
        return None
    return where.publish_next(staged, "kind=added/seq=", _segments(spark, path)[1])


def _latest(rows: DataFrame) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("key", "kind", "seq", "bucket")]
    last = rows.groupBy("key", "bucket").agg(F.max_by(F.struct(*rest), "seq").alias("_r"))
    return last.select("key", "bucket", *[F.col("_r")[c].alias(c) for c in rest])


def stored(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame | None:
    """(key, ...): the latest result of each key, or of those in ``keys``; None for an empty store.

    Of ``keys`` only the buckets are read that they fall into; their numbers,
    BUCKETS at most, come to the driver.
    """
    segments, _ = _segments(spark, path)
    if not segments:
        return None
    rows = spark.read.option("basePath", path).parquet(*segments)
    if keys is not None:
        wanted = keys.select("key").distinct()
        few = [r["b"] for r in wanted.select(_bucket().alias("b")).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(few)).join(wanted, "key", "left_semi")
    return _latest(rows).drop("bucket")


def compact(spark: SparkSession, path: str) -> None:
    """Rewrites the store as one segment with the latest result of each key; readers see the old segments or the new one."""
    segments, last = _segments(spark, path)
    if len(segments) < 2:
        return
    where, staged = Folder(spark, path), f"staged/{uuid.uuid4().hex}"
    _latest(spark.read.option("basePath", path).parquet(*segments)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{staged}")
    if where.publish(staged, f"kind=whole/seq={last:0{DIGITS}d}"):
        for old in segments:
            where.delete(old.removeprefix(f"{path}/"))


def results_of(keys: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, ...) for each of ``keys``: stored results, and for the others those of ``compute``, which are stored too.

    ``compute`` gets the new keys, each once, and returns rows (key, ...) of
    those it succeeds with; failures aren't stored, so they come again.
    """
    spark, known = keys.sparkSession, None
    wanted = keys.select("key").distinct()
    if (known := stored(spark, path, keys)) is not None:
        wanted = wanted.join(known.select("key"), "key", "left_anti")
    add_results(compute(wanted), path)
    found = stored(spark, path, keys)
    return compute(wanted.limit(0)) if found is None else found
