"""Comparison of methods over a table of confusion counts at cuts X: summaries, paired tests, ranks.

The heavy part - ranks and sums - is relational; the tails of the normal and
chi-square distributions are taken of a few rows per method by Pandas UDFs.
"""

from __future__ import annotations

import math
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept
from .ordered import cumulative, mean_ranked, quantiles

EPS = 1e-12
#: Methods that are never compared.
EXCLUDED = ["phi Clr", "rho Clr"]
REQUIRED = ["Files", "X", "TP", "TN", "FP", "FN", "TPR", "TNR", "precision", "recall", "f1_score"]


def cleaned(df: DataFrame) -> DataFrame:
    """``df`` without excluded methods, numbers cast and null where they aren't numbers; missing columns are an error."""
    if missing := sorted(set(REQUIRED) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df.filter(~F.col("Files").isin(EXCLUDED)).withColumns({c: F.col(c).try_cast("double") for c in REQUIRED if c != "Files"})


def overview(df: DataFrame) -> DataFrame:
    missing = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"), F.count_distinct("Files").alias("n_methods"), missing.alias("missing_values"), F.min("X").alias("x_min"), F.max("X").alias("x_max"))


def coverage(df: DataFrame) -> DataFrame:
    out = df.groupBy("Files").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("X").alias("unique_x"), F.min("X").alias("x_min"), F.max("X").alias("x_max"))
    return out.withColumn("complete", (F.col("unique_x") == 100) & (F.col("x_min") == 1) & (F.col("x_max") == 100))


def recomputed() -> dict[str, Column]:
    """The rates as they follow from the counts."""
    tp, tn, fp, fn = map(F.col, ("TP", "TN", "FP", "FN"))
    tpr, precision = tp / (tp + fn + EPS), tp / (tp + fp + EPS)
    return {"TPR": tpr, "TNR": tn / (tn + fp + EPS), "precision": precision, "recall": tpr, "f1_score": 2 * precision * tpr / (precision + tpr + EPS)}


def differences(df: DataFrame) -> DataFrame:
    """One row: the largest deviation of each given rate from the recomputed one."""
    return df.agg(*[F.max(F.abs(F.col(c) - x)).alias(f"max_diff_{c}") for c, x in recomputed().items()])


def derived(df: DataFrame) -> DataFrame:
    """``df`` with fpr, balanced_accuracy, NPV and mcc (0 where it is undefined)."""
    tp, tn, fp, fn = map(F.col, ("TP", "TN", "FP", "FN"))
    under = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return df.withColumns({"fpr": 1 - F.col("TNR"), "balanced_accuracy": (F.col("TPR") + F.col("TNR")) / 2, "NPV": tn / (tn + fn + EPS), "mcc": F.when(under > 0, (tp * tn - fp * fn) / under).otherwise(0.0)})


def area(df: DataFrame, x: str, y: str, key: str = "Files") -> DataFrame:
    """(key, area): trapezoids under the mean of y per x; null for fewer than two distinct x."""
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, F.col(x).alias("_x")).agg(F.avg(y).alias("_y"))
    w = Window.partitionBy(key).orderBy("_x")
    steps = points.withColumn("_part", (F.col("_x") - F.lag("_x").over(w)) * (F.col("_y") + F.lag("_y").over(w)) / 2)
    return steps.groupBy(key).agg(F.sum("_part").alias("area"))


def grouped_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per group: the named quantiles (column, fraction), exact for groups of any size; null where a group has no value."""
    found = quantiles(df, list(dict.fromkeys(c for c, _ in wanted.values())), sorted({p for _, p in wanted.values()}), keys)
    return found.groupBy(*keys).agg(*[F.max(F.when((F.col("column") == c) & (F.col("fraction") == p), F.col("value"))).alias(name) for name, (c, p) in wanted.items()])


def summary(df: DataFrame) -> DataFrame:
    """One row per method: medians, quantiles, areas, segment medians, and the rank by median F1, AUPRC, Q10, IQR and name."""
    part = lambda a, b: F.when(F.col("X").between(a, b), F.col("f1_score"))
    df = kept(df, "compared")  # the quantiles take several passes
    rows = df.select("Files", "f1_score", "balanced_accuracy", "mcc", part(1, 33).alias("_s1"), part(34, 66).alias("_s2"), part(67, 100).alias("_s3"))
    out = grouped_quantiles(rows, ["Files"], {
        "Median_F1": ("f1_score", 0.5), "Median_Balanced_Accuracy": ("balanced_accuracy", 0.5), "Median_MCC": ("mcc", 0.5), "Q10_F1": ("f1_score", 0.1), "_q1": ("f1_score", 0.25), "_q3": ("f1_score", 0.75),
        "Segment1_Median_F1": ("_s1", 0.5), "Segment2_Median_F1": ("_s2", 0.5), "Segment3_Median_F1": ("_s3", 0.5),
    })
    out = df.groupBy("Files").agg(F.max("f1_score").alias("Max_F1")).join(out, "Files", "left").withColumn("IQR_F1", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")
    out = out.join(area(df, "fpr", "TPR").withColumnRenamed("area", "AUROC"), "Files", "left").join(area(df, "recall", "precision").withColumnRenamed("area", "AUPRC"), "Files", "left")
    by = Window.orderBy(F.desc("Median_F1"), F.desc("AUPRC"), F.desc("Q10_F1"), "IQR_F1", "Files")  # a row per method
    return out.withColumn("rank", F.row_number().over(by))


def box_diagnosis(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per metric and method: count, distinct values, quartiles, range, and whether the box is degenerate."""
    rows = kept(df.unpivot(["Files"], metrics, "metric", "value").filter("value IS NOT NULL"), "boxes")
    counts = rows.groupBy("metric", "Files", "value").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("metric", "Files").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unique"), F.min("value").alias("least"), F.max("value").alias("most"))
    out = out.join(grouped_quantiles(rows, ["metric", "Files"], {"q1": ("value", 0.25), "median": ("value", 0.5), "q3": ("value", 0.75)}), ["metric", "Files"])
    return out.withColumn("iqr", F.col("q3") - F.col("q1")).withColumn("degenerate", F.col("iqr") <= EPS)


@F.pandas_udf(T.DoubleType())
def normal_above(z: pd.Series) -> pd.Series:
    """The upper tail of the standard normal distribution."""
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)))


#: Differences up to which the exact distribution of the rank sum is used.
EXACT = 50


@cache
def _rank_sums(n: int) -> list[int]:
    """How many subsets of 1 to n have each sum."""
    counts = [1]
    for k in range(1, n + 1):
        counts = [(counts[s] if s < len(counts) else 0) + (counts[s - k] if 0 <= s - k < len(counts) else 0) for s in range(len(counts) + k)]
    return counts


@F.pandas_udf(T.DoubleType())
def rank_sum_above(w: pd.Series, n: pd.Series) -> pd.Series:
    """The exact probability of a positive rank sum of ``w`` or more among n differences without ties."""
    return pd.Series([sum(_rank_sums(int(k))[int(x) :]) / 2 ** int(k) if 0 < k <= EXACT else None for x, k in zip(w, n)], dtype=float)


def _gamma_above(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # by the series of the lower one
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    f, c, d = 1e-300, 1e300, 0.0  # by its continued fraction
    b = x + 1 - a
    d = 1 / b
    f = d
    c = 1e300
    for i in range(1, 10_000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or 1e-300)
        c = b + k / c or 1e-300
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


@F.pandas_udf(T.DoubleType())
def chi_square_above(x: pd.Series, freedom: pd.Series) -> pd.Series:
    """The upper tail of the chi-square distribution."""
    return pd.Series([_gamma_above(k / 2, v / 2) for v, k in zip(x, freedom)])


def signed_ranks(pairs: DataFrame, *keys: str) -> DataFrame:
    """Per keys, of differences ``diff``: n, n_nonzero, w_plus, w_minus, ties (sum of t^3 - t), median and the shares above, at and below 0.

    Differences of one size are counted before they are ranked, so ties cost
    one row, and a group may span many tasks.
    """
    pairs = kept(pairs, "pairs")
    sizes = pairs.filter("diff != 0").groupBy(*keys, F.abs("diff").alias("_size")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("diff") > 0).alias("_plus"))
    rank = F.col("_before") + (F.col("n") + 1) / 2
    sums = cumulative(sizes, list(keys), "_size").groupBy(*keys).agg(
        F.sum("n").alias("n_nonzero"), F.sum(F.col("_plus") * rank).alias("w_plus"), F.sum((F.col("n") - F.col("_plus")) * rank).alias("w_minus"), F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("ties")
    )
    share = lambda c: F.avg(c.cast("double"))
    d = F.col("diff")
    every = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), share(d > 0).alias("better_rate"), share(d == 0).alias("equal_rate"), share(d < 0).alias("worse_rate"))
    every = every.join(grouped_quantiles(pairs, list(keys), {"median_diff": ("diff", 0.5)}), list(keys), "left")
    return every.join(sums, list(keys), "left").na.fill(0, ["n_nonzero", "w_plus", "w_minus", "ties"])


def wilcoxon(ranks: DataFrame, alternative: str = "greater") -> DataFrame:
    """``signed_ranks`` with z, statistic, p_value and rank_biserial.

    Exact for up to ``EXACT`` differences if none is 0 and no two are of one
    size, else the normal approximation with the correction for ties; where no
    difference is left the statistic is 0 and p is 1.
    """
    n = F.col("n_nonzero")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    none = (n == 0) | (var <= 0)
    z = F.when(none, 0.0).otherwise((F.col("w_plus") - mean) / F.sqrt(F.when(none, 1.0).otherwise(var)))
    exact = (n > 0) & (n <= EXACT) & (n == F.col("n")) & (F.col("ties") == 0)
    above = F.when(exact, rank_sum_above(F.col("w_plus"), n.cast("double")))
    if alternative == "greater":
        statistic, p = F.col("w_plus"), F.coalesce(above, normal_above(z))
    else:
        below = F.when(exact, rank_sum_above(F.col("w_minus"), n.cast("double")))
        statistic, p = F.least("w_plus", "w_minus"), F.least(F.lit(1.0), 2 * F.coalesce(F.least(above, below), normal_above(F.abs(z))))
    whole = F.col("w_plus") + F.col("w_minus")
    p = F.when(n == 0, 1.0).when(exact, p).when(none, 1.0).otherwise(p)
    return ranks.withColumns({"z": z, "statistic": statistic, "p_value": p, "rank_biserial": F.when(whole == 0, 0.0).otherwise((F.col("w_plus") - F.col("w_minus")) / whole)})


def holm(df: DataFrame, p: str, keys: list[str], ties: list[str], out: str = "p_holm") -> DataFrame:
    """``df`` with Holm's step-down adjustment of ``p`` within ``keys``."""
    order = Window.partitionBy(*keys).orderBy(p, *ties)
    step = (F.count(F.lit(1)).over(Window.partitionBy(*keys)) - F.row_number().over(order) + 1) * F.col(p)
    df = df.withColumn("_step", step)
    return df.withColumn(out, F.least(F.lit(1.0), F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def paired(df: DataFrame, metric: str, anchor: str, higher_is_better: bool = True) -> DataFrame:
    """(method, X, diff): the anchor's value against each method's at the same X; positive where the anchor is better."""
    a = df.filter(F.col("Files") == anchor).select("X", F.col(metric).alias("_a"))
    b = df.filter(F.col("Files") != anchor).select("X", F.col("Files").alias("method"), F.col(metric).alias("_b"))
    diff = F.col("_a") - F.col("_b") if higher_is_better else F.col("_b") - F.col("_a")
    return a.join(b, "X").select("method", "X", diff.alias("diff"))


def against_anchor(df: DataFrame, metric: str, anchor: str, higher_is_better: bool = True) -> DataFrame:
    """One row per other method: paired one-sided test against the anchor, Holm-adjusted."""
    out = wilcoxon(signed_ranks(paired(df, metric, anchor, higher_is_better), "method")).withColumn("metric", F.lit(metric))
    return holm(out, "p_value", ["metric"], ["method"]).withColumn("significant", F.col("p_holm") < 0.05)


def all_pairs(df: DataFrame, metric: str) -> DataFrame:
    """(a, b, ...) for every two methods a < b: paired two-sided test, Holm-adjusted."""
    one = df.select("X", F.col("Files").alias("a"), F.col(metric).alias("_a"))
    two = df.select("X", F.col("Files").alias("b"), F.col(metric).alias("_b"))
    pairs = one.join(two, "X").filter("a < b").select("a", "b", "X", (F.col("_a") - F.col("_b")).alias("diff"))
    out = wilcoxon(signed_ranks(pairs, "a", "b"), "two-sided").withColumn("_all", F.lit(1))
    return holm(out, "p_value", ["_all"], ["a", "b"]).drop("_all").withColumn("significant", F.col("p_holm") < 0.05)


def ranks_per_cut(df: DataFrame, metric: str) -> DataFrame:
    """(Files, X, rank): the methods' ranks at each X, best first, ties shared."""
    return mean_ranked(df.select("Files", "X", metric), ["X"], -F.col(metric)).select("Files", "X", "rank")


def mean_ranks(df: DataFrame, metric: str) -> DataFrame:
    return ranks_per_cut(df, metric).groupBy("Files").agg(F.avg("rank").alias("mean_rank"))


def friedman(df: DataFrame, metric: str) -> DataFrame:
    """One row: statistic with the correction for ties, p_value, n_blocks, k_methods, kendall_w; null if the methods never differ."""
    ranked = kept(ranks_per_cut(df, metric), "ranks")
    sums = ranked.groupBy("Files").agg(F.sum("rank").alias("r")).agg(F.sum(F.col("r") * F.col("r")).alias("squares"), F.count(F.lit(1)).alias("k"))
    ties = ranked.groupBy("X", "rank").agg(F.count(F.lit(1)).alias("t")).groupBy("X").agg(F.sum(F.col("t") * (F.col("t") * F.col("t") - 1)).alias("t")).agg(F.sum("t").alias("ties"), F.count(F.lit(1)).alias("n"))
    k, n = F.col("k"), F.col("n")
    spread = 1 - F.col("ties") / (n * k * (k * k - 1))
    raw = 12 / (n * k * (k + 1)) * F.col("squares") - 3 * n * (k + 1)
    out = sums.crossJoin(F.broadcast(ties)).withColumn("statistic", F.when(spread > 0, raw / F.when(spread > 0, spread)))
    out = out.withColumn("p_value", F.when(F.col("statistic").isNotNull(), chi_square_above(F.coalesce("statistic", F.lit(0.0)), (k - 1).cast("double"))))
    return out.select("statistic", "p_value", n.alias("n_blocks"), k.alias("k_methods"), (F.col("statistic") / (n * (k - 1))).alias("kendall_w"))


def decision(tests: DataFrame, anchor: str) -> DataFrame:
    """One row: the best method and those it isn't significantly better than."""
    ties = tests.agg(F.collect_list(F.when(~F.col("significant"), F.col("method"))).alias("t"))
    names = F.array_sort(F.concat(F.array(F.lit(anchor)), "t"))
    return ties.select(F.lit(anchor).alias("best_method"), F.array_join(names, ";").alias("co_best_methods"), F.size(names).alias("co_best_count"))
