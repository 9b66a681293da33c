"""Catalogue of archived runs: index, search, records, set operations over articles and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quadrant import priority


def with_latest(rows: DataFrame, latest: DataFrame, keys: Sequence[str], value: str, order: str = "at") -> DataFrame:
    """``rows`` with ``value`` replaced by that of ``latest`` where it has one; of repeated keys the last counts."""
    last = latest.groupBy(*keys).agg(F.max_by(value, order).alias("_latest"))
    return rows.join(last, list(keys), "left").withColumn(value, F.coalesce("_latest", value)).drop("_latest")


def merged_stages(rows: DataFrame, second: DataFrame, evidence: DataFrame, keys: Sequence[str], over: Sequence[str]) -> DataFrame:
    """Records with the second stage's fields laid over where they aren't null, and evidence fields (prefixed evidence_) added."""
    keys = list(keys)
    two = second.select(*keys, *[F.col(c).alias(f"_{c}") for c in over])
    out = rows.join(two, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in over}).drop(*[f"_{c}" for c in over])
    extra = evidence.select(*keys, *[F.col(c).alias(f"evidence_{c}") for c in evidence.columns if c not in keys])
    return out.join(extra, keys, "left")


def nested_key(field: str, *paths: str) -> Column:
    """The field itself or the first of the nested ones that isn't null."""
    return F.coalesce(F.col(field), *[F.col(f"{p}.{field}") for p in paths])


def run_meta(rows: DataFrame, target: str, created: str) -> DataFrame:
    """One row per run_id: candidates, the commonest source as hint, target, and when it was made."""
    n = rows.groupBy("run_id", "src").agg(F.count(F.lit(1)).alias("n"))
    hint = n.groupBy("run_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "src")).alias("h"))
    out = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.min(target).alias("target"), F.max(created).alias("created_at"))
    return out.join(hint, "run_id").select("run_id", "target", "candidate_count", F.col("h.src").alias("source_hint"), "created_at")


INDEX = ["run_id", "src", "mid", "target", "quadrant", "composite_score", "signal", "novelty", "computed_at"]


def index(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """The flat index of all runs' records, a missing target taken from the run, newest runs and best scores first."""
    m = meta.select("run_id", F.col("target").alias("_target"), F.col("created_at").alias("computed_at"))
    out = rows.join(m, "run_id").withColumn("target", F.coalesce(F.nullif("target", F.lit("")), "_target"))
    return out.select(INDEX)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.coalesce("computed_at", F.lit("")).desc(), F.coalesce("composite_score", F.lit(0.0)).desc(), "run_id", "src", "mid")


def holds(column: str, needle: str) -> Column:
    """Whether a text column holds the needle, whatever the case; an empty one is in all."""
    return F.lit(True) if not needle.strip() else F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle.strip().lower()))


def search(df: DataFrame, q: str = "", src: str = "", mid: str = "", quadrant: str = "", target: str = "", run_id: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the index: exact run and quadrant, contained names and free text; by quadrant, then signal."""
    rows = matching(df, q, src, mid, quadrant, target, run_id)
    return rows.orderBy(priority(), F.desc("signal"), "run_id", "src", "mid").offset(offset).limit(limit)


def matching(df: DataFrame, q: str = "", src: str = "", mid: str = "", quadrant: str = "", target: str = "", run_id: str = "") -> DataFrame:
    rows = df
    for column, value in (("run_id", run_id), ("quadrant", quadrant)):
        if value:
            rows = rows.filter(F.col(column) == value)
    free = holds("src", q) | holds("mid", q) | holds("target", q)
    return rows.filter(holds("src", src) & holds("mid", mid) & holds("target", target) & free)


def run_list(meta: DataFrame) -> DataFrame:
    return meta.orderBy(F.desc("created_at"), "run_id")


def detail(record: DataFrame) -> DataFrame:
    """Records with their scores and their place gathered in structs."""
    return record.select("run_id", "src", "mid", F.struct("signal", "novelty", "composite_score").alias("scores"), F.struct("quadrant", "target").alias("place"))


def exported(record: DataFrame) -> DataFrame:
    """(run_id, src, mid, document): each record as one JSON text."""
    d = detail(record)
    return d.select("run_id", "src", "mid", F.to_json(F.struct("run_id", "src", "mid", "scores", "place")).alias("document"))


def first_of(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """One row per keys, the first in order."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def set_sizes(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: how many distinct values are in both, only in the first, only in the second."""
    x, y = a.select(column).distinct().withColumn("_a", F.lit(1)), b.select(column).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, column, "full_outer")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_first"), F.count_if(F.col("_a").isNull()).alias("n_second"))
