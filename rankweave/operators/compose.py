"""Compositional transforms of feature-by-sample tables in long form: feature, sample, value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept


def made_positive(df: DataFrame, shift: bool = False, value: str = "value") -> DataFrame:
    """``df`` with zeros replaced by the smallest value that isn't zero; with ``shift``, moved up first so that the least value is 1e-6 if any is 0 or below."""
    if shift:
        least = df.agg(F.min(value).alias("_least"))
        df = df.crossJoin(F.broadcast(least)).withColumn(value, F.when(F.col("_least") <= 0, F.col(value) - F.col("_least") + 1e-6).otherwise(F.col(value))).drop("_least")
    least = df.agg(F.min(F.when(F.col(value) != 0, F.col(value))).alias("_least"))
    return df.crossJoin(F.broadcast(least)).withColumn(value, F.when(F.col(value) == 0, F.col("_least")).otherwise(F.col(value))).drop("_least")


def clr(df: DataFrame, sample: str = "sample", value: str = "value", shift: bool = False) -> DataFrame:
    """``df`` with clr: the logarithm of each value less the mean logarithm of its sample."""
    df = made_positive(df, shift, value).withColumn("_log", F.log(value))
    means = df.groupBy(sample).agg(F.avg("_log").alias("_mean"))
    return df.join(means, sample).withColumn("clr", F.col("_log") - F.col("_mean")).drop("_log", "_mean")


def feature_means(df: DataFrame, feature: str = "feature", value: str = "clr") -> DataFrame:
    return df.groupBy(feature).agg(F.avg(value).alias("mean"))


def correlated(df: DataFrame, most_p: float = 0.05) -> DataFrame:
    """Rows of (src, mid, cor, pval) with a positive correlation and a small p-value."""
    return df.filter(F.col("cor").isNotNull() & F.col("pval").isNotNull() & (F.col("cor") > 0) & (F.col("pval") < most_p))


def roots(correlations: DataFrame, means: DataFrame, ranks: Sequence[int] = (1, 2, 3, 5), most_p: float = 0.05) -> DataFrame:
    """(src, mid, rank_limit, cor, pval, mean): the ``rank_limit`` correlated features of the largest means, for each limit."""
    rows = correlated(correlations, most_p).join(means.withColumnRenamed("feature", "mid"), "mid")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("mean"), "mid"))).filter(F.col("_nth") <= max(ranks))
    rows = rows.withColumn("rank_limit", F.explode(F.array(*map(F.lit, ranks)))).filter("_nth <= rank_limit")
    return rows.select("src", "mid", "rank_limit", "cor", "pval", "mean")


def interactions(mids: DataFrame, srcs: DataFrame) -> DataFrame:
    """(sample, pair, score): the product of each feature's and each target's clr in the same sample; pair is "mid-src"."""
    a = mids.select("sample", F.col("feature").alias("mid"), F.col("clr").alias("x"))
    b = srcs.select("sample", F.col("feature").alias("src"), F.col("clr").alias("y"))
    return a.join(b, "sample").select("sample", F.concat_ws("-", "mid", "src").alias("pair"), (F.col("x") * F.col("y")).alias("score"))


def unmatched_samples(a: DataFrame, b: DataFrame) -> DataFrame:
    """Samples that only one side has; empty if the two tables fit together."""
    return a.select("sample").distinct().join(b, "sample", "left_anti").union(b.select("sample").distinct().join(a, "sample", "left_anti"))


def nonzero_columns(df: DataFrame, column: str = "pair", value: str = "score") -> DataFrame:
    """Rows of columns whose values don't add up to 0; missing values count as 0."""
    keep = df.groupBy(column).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("_sum")).filter("_sum != 0").drop("_sum")
    return df.join(keep, column, "left_semi")


def wide(df: DataFrame, rows: str, column: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per name, 0 where there is no value; for sinks."""
    return df.groupBy(rows).pivot(column, list(names)).agg(F.first(value)).na.fill(0)


def long(df: DataFrame, keep: Sequence[str], column: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(keep), [c for c in df.columns if c not in keep], column, value)


#: The grids of the parameter search, whole and for a smoke test.
GRID = {"dims": [2, 3, 5, 8, 10, 15, 20], "neighbours": [2, 3, 5, 10, 15, 20], "distance": [0.1, 0.5, 1.0], "metric": ["cosine", "euclidean"], "resolution": [0.1, 0.5]}
SMOKE = {"dims": [2, 3], "neighbours": [5, 10], "distance": [0.1], "metric": ["cosine"], "resolution": [0.1]}


def grid(spark, values: dict[str, Sequence]) -> DataFrame:
    """Every combination of the values of fixed lists."""
    df = spark.range(1).drop("id")
    for name, some in values.items():
        df = df.withColumn(name, F.explode(F.array(*map(F.lit, some))))
    return df


def to_do(tasks: DataFrame, log: DataFrame, outputs: DataFrame, expected: int, key: str = "tag") -> DataFrame:
    """Tasks that aren't complete: none that is logged as OK and has all its ``expected`` outputs."""
    done = log.filter("status = 'OK'").select(key).distinct()
    whole = outputs.groupBy(key).agg(F.count_distinct("output").alias("n")).filter(F.col("n") >= expected)
    return tasks.join(done.join(whole, key, "left_semi"), key, "left_anti")


def resolved_roots(wanted: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rank_limit, mid) whose mid is present, and the rank limits that have none."""
    found = wanted.join(present.select("mid").distinct(), "mid").select("rank_limit", "mid")
    return found, wanted.select("rank_limit").distinct().join(found, "rank_limit", "left_anti")


def run_summary(log: DataFrame, task: str = "task") -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("OK", "SKIP", "FAIL")]
    return log.groupBy(task).agg(F.count(F.lit(1)).alias("n"), *counts).withColumn("failed", F.col("n_fail") > 0)


def principal_components(df: DataFrame, k: int, rows: str = "pair", column: str = "sample", value: str = "score", columns: Sequence[str] = ()) -> DataFrame:
    """(rows, pc): each row's first ``k`` principal components over ``columns``, in order; a component's sign is arbitrary."""
    from pyspark.ml.feature import PCA, VectorAssembler

    table = wide(df, rows, column, value, columns)
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(table)
    from pyspark.ml.functions import vector_to_array

    return PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors).transform(vectors).select(rows, vector_to_array("_p").alias("pc"))


def ordering(edges: DataFrame, roots: DataFrame, width: float | None = None) -> DataFrame:
    """(id, distance): the shortest distance of each reachable node from the nearest root over (a, b, length) edges in both directions.

    Nodes are settled in bands of distance, ``width`` wide (eight mean lengths
    if it isn't given).  Within a band only nodes that came closer go on, over
    edges no longer than the band is wide, until none does; then the band's
    nodes, now settled, go on over the longer edges once.  Each round joins its
    frontier alone with the edges.  An edge without a length is none; negative
    lengths have no shortest distance and raise ValueError.  An approximation of
    a trajectory's ordering from its neighbour graph, not a solver's result.
    """
    edges = edges.filter("length IS NOT NULL")
    both = edges.select("a", "b", "length").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "length"))
    both = kept(both.groupBy("a", "b").agg(F.min("length").alias("length")), "edges")
    about = both.agg(F.min("length").alias("least"), F.avg("length").alias("mean")).first()
    if about["least"] is not None and about["least"] < 0:
        raise ValueError("lengths must not be negative")
    width = width or 8 * (about["mean"] or 0) or 1.0
    # todo: 1, all edges still have to be followed; 2, only long ones; 0, none
    state = kept(roots.select("id").distinct().select("id", F.lit(0.0).alias("distance"), F.lit(1).alias("todo")), "ordered")
    end = width
    while True:
        front = state.agg(F.count_if((F.col("todo") == 1) & (F.col("distance") < end)).alias("near"), F.count_if(F.col("todo") == 2).alias("settled"), F.min(F.when(F.col("todo") == 1, F.col("distance"))).alias("next")).first()
        if not front["near"]:
            if not front["settled"] and front["next"] is None:
                return state.select("id", "distance")
            if not front["settled"]:
                end = (front["next"] // width + 1) * width
                continue
        goes = (F.col("todo") == 1) & (F.col("distance") < end) if front["near"] else F.col("todo") == 2
        usable = F.col("length") <= width if front["near"] else F.col("length") > width
        reached = state.filter(goes).join(both.filter(usable), F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min(F.col("distance") + F.col("length")).alias("new"))
        after = F.when(goes, F.lit(2 if front["near"] else 0)).otherwise(F.col("todo"))
        met = state.select("id", "distance", after.alias("todo")).join(reached, "id", "full_outer")
        closer = F.coalesce(F.col("new") < F.col("distance") - 1e-12, F.col("distance").isNull())
        state = kept(met.select("id", F.when(closer, F.col("new")).otherwise(F.col("distance")).alias("distance"), F.when(closer, 1).otherwise(F.col("todo")).alias("todo")), "ordered", after=[state])


def tasks_by_metric(sources: DataFrame, key: str) -> DataFrame:
    """(key, metric, n, n_distinct): each source's ``tasks``, an array of configurations, counted by metric within its row.

    A source's tasks lie in one row, so no table holds all tasks of all sources at once.
    """
    of = lambda m: F.filter("tasks", lambda c: c["metric"].eqNullSafe(m))
    metrics = F.array_distinct(F.transform("tasks", lambda c: c["metric"]))
    counts = F.transform(metrics, lambda m: F.struct(m.alias("metric"), F.size(of(m)).cast("long").alias("n"), F.size(F.array_distinct(F.transform(of(m), lambda c: F.to_json(c)))).cast("long").alias("n_distinct")))
    return sources.select(key, F.explode(counts).alias("c")).select(key, "c.*")
