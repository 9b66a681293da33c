"""Rank-based signal of (source, intermediate) pairs from a position on a trajectory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from .ordered import SENT, joined, ranked


def usable(df: DataFrame, value: str = "value", file: str | None = None) -> DataFrame:
    """Rows with a value; of files whose largest value isn't positive none.  A row per file goes to all tasks, the rows stay where they are."""
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    if file is None:
        return rows
    good = rows.groupBy(file).agg(F.max(value).alias("_most")).filter("_most > 0").select(file)
    return joined(rows, F.broadcast(good), [file])


#: Rows of a source that one task ranks; larger sources are ranked by several.
ONE_TASK = 1_000_000


def dual_end_signal(df: DataFrame, src: str = "src", value: str = "value", order: Sequence[str] = ("mid",)) -> DataFrame:
    """``df`` with distance_to_end, signal and total_in_src.

    The closer a value is to either end of its source's range (0 or the
    maximum), the higher its signal: 1 - (rank - 1) / n.  ``order`` breaks
    ties.  Sources of up to ONE_TASK rows are ranked within a task; where there is
    a larger one, all are ranked by range, and a source may span many tasks.
    """
    about = kept(df.groupBy(src).agg(F.max(value).alias("_most"), F.count(F.lit(1)).alias("total_in_src")), "sources")
    df = joined(df, about, [src]).withColumn("distance_to_end", F.least(F.col(value), F.col("_most") - F.col(value))).drop("_most")
    if (about.agg(F.max("total_in_src")).first()[0] or 0) <= ONE_TASK:
        df = df.withColumn("_near", F.row_number().over(Window.partitionBy(src).orderBy("distance_to_end", *order)))
    else:
        df = ranked(df, [src], ["distance_to_end", *order], "_near")
    return df.withColumn("signal", F.lit(1.0) - (F.col("_near") - 1) / F.col("total_in_src")).drop("_near")


def rank_in_source(df: DataFrame, src: str = "src", value: str = "value", order: Sequence[str] = ("mid",)) -> DataFrame:
    """``df`` with rank_in_src: the place of each row in its source by falling value."""
    return ranked(df, [src], [F.desc(value), *order], "rank_in_src")


def rank_of_few(few: DataFrame, df: DataFrame, src: str = "src", value: str = "value", order: Sequence[str] = ("mid",)) -> DataFrame:
    """``few`` rows of ``df`` with rank_in_src, counted in one pass over ``df`` without sorting it; ``few`` goes to all tasks and must be bounded."""
    here = few.withColumn("_key", F.struct(src, value, *order))
    sent = here.select("_key", *[F.col(f"_key.{c}").alias(f"_f{i}") for i, c in enumerate([src, value, *order])])
    own = [F.col(f"_f{i + 2}") for i in range(len(order))]
    before = (F.col(value) > F.col("_f1")) | ((F.col(value) == F.col("_f1")) & (F.struct(*order) <= F.struct(*[c.alias(o) for c, o in zip(own, order)])))
    n = df.select(src, value, *order).join(F.broadcast(sent), F.col(src).eqNullSafe(F.col("_f0")) & before).groupBy("_key").agg(F.count(F.lit(1)).alias("rank_in_src"))
    return joined(here, n, ["_key"]).drop("_key")


def first_per_pair(df: DataFrame, keys: Sequence[str] = ("src", "mid"), best: str = "signal", order: Sequence[str] = ()) -> DataFrame:
    """Of the rows of a pair the one with the largest ``best``, the first in ``order``; most rows of a large pair go before anything moves."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(best), *order))
    return df.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def top(df: DataFrame, n: int = 200, best: str = "signal", order: Sequence[str] = ("src", "mid")) -> DataFrame:
    return df.orderBy(F.desc(best), *order).limit(n)


def candidates(coordinates: DataFrame, n: int = 200, order: Sequence[str] = ("mid",), file: str | None = None) -> DataFrame:
    """src, mid, value, signal, rank_in_src, total_in_src of the ``n`` best pairs of (src, mid, value) rows.

    One sort gives all signals; the other rank is counted for the ``n`` best alone.
    """
    rows = kept(usable(coordinates, file=file), "usable")
    best = kept(top(first_per_pair(dual_end_signal(rows, order=order), order=order), n), "best")
    best = rank_of_few(best, rows, order=order) if n <= SENT else joined(best, rank_in_source(rows, order=order).select("src", "value", *order, "rank_in_src"), ["src", "value", *order])
    return best.select("src", "mid", F.round("value", 4).alias("value"), F.round("signal", 4).alias("signal"), "rank_in_src", "total_in_src")
