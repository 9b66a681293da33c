"""Path scores from how new a path's nodes are and how well its edges are supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import degrees

UNKNOWN_AGE = 5


def credibility(edges: DataFrame) -> DataFrame:
    """(id, credibility): the mean impact of a node's edges that have one, 1 if none has."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "impact")
    return ends.groupBy("id").agg(F.coalesce(F.avg(F.when(F.col("impact") != 0, F.col("impact"))), F.lit(1.0)).alias("credibility"))


def node_weights(edges: DataFrame) -> DataFrame:
    """(id, new, weight): new is 1 where no edge leads on; the weight is new * (1 + credibility)."""
    rows = degrees(edges).join(credibility(edges), "id")
    new = (F.col("out_degree") == 0).cast("double")
    return rows.select("id", new.alias("new"), (new * (1 + F.col("credibility"))).alias("weight"))


def reference_weight(year_now: int) -> Column:
    """impact * citations / (age + 1); 0 without impact or citations, an unknown year is five years ago."""
    age = F.coalesce(F.greatest(F.lit(year_now) - F.col("year"), F.lit(0)), F.lit(UNKNOWN_AGE))
    return F.coalesce(F.col("impact") * F.col("cites") / (age + 1), F.lit(0.0))


def supports(edges: DataFrame, year_now: int) -> DataFrame:
    """(a, b, support, resistance) of each pair of nodes with an edge in either direction, a <= b."""
    rows = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), reference_weight(year_now).alias("w"))
    return rows.groupBy("a", "b").agg(F.sum("w").alias("support")).withColumn("resistance", 1 / (1 + F.col("support")))


def path_scores(edges: DataFrame, paths: DataFrame, year_now: int) -> DataFrame:
    """(path_id, score, energy, resistance) of ``paths`` (path_id, nodes).

    energy = sqrt(number of new nodes) * sum of squared weights.  The score is
    energy over resistance; 1 over resistance where no node is new; 0 for a
    path without an edge.
    """
    steps = paths.select("path_id", F.posexplode("nodes").alias("i", "id"), "nodes")
    weights = node_weights(edges)
    own = steps.join(weights, "id", "left").groupBy("path_id").agg(F.coalesce(F.sum("new"), F.lit(0.0)).alias("m"), F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0)).alias("squares"))
    moves = steps.filter(F.col("i") < F.size("nodes") - 1).withColumn("to", F.element_at("nodes", F.col("i") + 2))
    moves = moves.select("path_id", F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))
    total = moves.join(supports(edges, year_now), ["a", "b"], "left").groupBy("path_id").agg(F.sum(F.coalesce("resistance", F.lit(1.0))).alias("resistance"))
    out = own.join(total, "path_id", "left").withColumn("energy", F.sqrt("m") * F.col("squares"))
    r = F.coalesce("resistance", F.lit(0.0))
    score = F.when((F.col("energy") > 0) & (r > 0), F.col("energy") / r).when(r > 0, 1 / r).otherwise(0.0)
    return out.select("path_id", score.alias("score"), "energy", r.alias("resistance"))


def best_paths(scores: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path_id, score): of each candidate the path of the largest score, the shorter, then the lesser id; none without a positive score."""
    rows = paths.join(scores, "path_id").filter("score > 0")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.size("nodes").alias("n"), "path_id")).alias("m")
    return rows.groupBy(*keys).agg(best).select(*keys, "m.path_id", (-F.col("m.s")).alias("score"))
