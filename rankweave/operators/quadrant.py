"""Novelty, median thresholds, quadrants and composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ordered import quantiles

#: Quadrants from the one worth most attention to the least.
ORDER = ["I", "II", "III", "IV"]


def novelty_by_batch(count: Column, most: Column) -> Column:
    """1 - ln(1 + count) / ln(1 + most), 1 where nothing was counted at all."""
    return F.when(most <= 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.log1p(F.coalesce(count, F.lit(0))) / F.log1p(most))


def novelty_by_ceiling(count: Column, ceiling: int = 500) -> Column:
    """The same against a fixed ceiling, within 0 and 1; 1 for counts that aren't positive."""
    raw = F.lit(1.0) - F.log1p(F.greatest(count, F.lit(0))) / F.log1p(F.lit(float(ceiling)))
    return F.when(count <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def medians(df: DataFrame, **columns: str) -> DataFrame:
    """One row with the exact median of each named column, 0.5 where there is none; ``df`` is read several times."""
    found = quantiles(df, list(dict.fromkeys(columns.values())), [0.5])
    return found.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("value"))), F.lit(0.5)).alias(name) for name, c in columns.items()])


def quadrant(signal: Column, novelty: Column, t1: Column, t2: Column) -> Column:
    """I: strong and new, II: new, III: strong, IV: neither.  A signal must exceed its threshold, novelty must reach it."""
    high, new = signal > t1, novelty >= t2
    return F.when(high & new, "I").when(new, "II").when(high, "III").otherwise("IV")


def composite(signal: Column, first: Column, second: Column) -> Column:
    """signal * (1 + log2(1 + first)) * (1 + log2(1 + second)), to four digits."""
    log = lambda c: F.lit(1.0) + F.log2(F.lit(1.0) + F.coalesce(c, F.lit(0)))
    return F.round(signal * log(first) * log(second), 4)


def assigned(df: DataFrame, signal: str = "signal", novelty: str = "novelty", first: str = "pair_sm_exp", second: str = "pair_md_exp") -> DataFrame:
    """``df`` with quadrant, is_dark (quadrant I), evidence_foundation and composite_score; missing signals are 0, missing novelty 1."""
    rows = df.withColumn(signal, F.coalesce(signal, F.lit(0.0))).withColumn(novelty, F.coalesce(novelty, F.lit(1.0)))
    rows = kept(rows, "scored")  # the medians take several passes
    rows = rows.crossJoin(F.broadcast(medians(rows, _t1=signal, _t2=novelty)))  # one row
    rows = rows.withColumn("quadrant", quadrant(F.col(signal), F.col(novelty), F.col("_t1"), F.col("_t2"))).drop("_t1", "_t2")
    return rows.withColumns({"is_dark": F.col("quadrant") == "I", "evidence_foundation": F.coalesce(second, F.lit(0)), "composite_score": composite(F.col(signal), F.col(first), F.col(second))})


def priority(column: str = "quadrant") -> Column:
    """0 to 3 for the quadrants in order, 9 for anything else."""
    at = F.array_position(F.array(*map(F.lit, ORDER)), F.col(column))
    return F.when(at > 0, at - 1).otherwise(F.lit(9)).cast("int")


def by_priority(df: DataFrame, second: str = "composite_score", *ties: str) -> DataFrame:
    return df.orderBy(priority(), F.desc(second), *ties)


def summary(df: DataFrame, novelty: str = "novelty") -> DataFrame:
    """One row: candidates, candidates per quadrant, dark ones, and the range of novelty."""
    counts = [F.count_if(F.col("quadrant") == q).alias(f"n_{q.lower()}") for q in ORDER]
    return df.agg(F.count(F.lit(1)).alias("n"), *counts, F.count_if("is_dark").alias("n_dark"), F.min(novelty).alias("least_novelty"), F.max(novelty).alias("most_novelty"))


def detected(df: DataFrame, column: str, default: str, order: str) -> DataFrame:
    """``df`` with ``column`` set throughout: the first row's value, or ``default`` if that is empty."""
    first = df.agg(F.min_by(column, order).alias("_first"))
    return df.drop(column).crossJoin(F.broadcast(first)).withColumn(column, F.when(F.coalesce("_first", F.lit("")) == "", default).otherwise(F.col("_first"))).drop("_first")
