"""Mixing sources to target weights by systematic sampling.

Each source has a target of words.  Every document of a source expects
``target / source_size`` copies.  The expected copies are summed along the
source in an order by size; one random offset per source is added, and a copy
is taken at every integer boundary that the running sum crosses.  Ordering by
size keeps the taken words within about one document of the target.

The running sum is built in three levels - size classes within a source, hash
slots within a class, rows within a slot - so that no task ever holds a whole
source.  Only built-in DataFrame functions run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh_names, written

SLOTS = 256


def words_in(text: Column) -> Column:
    """The words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(source, source_size) with targets added: weights repeat over the sources by code point, null last.

    Together the targets make ``share`` of all sizes.  No target exceeds
    ``cap`` times its source's size; what exceeds it is shared out anew by
    weight.  In closed form: sort by cap per weight; the first source at which
    the rest, shared by weight, stays under its cap sets the level for itself
    and all after it.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("nth") - 1, F.lit(len(weights))).cast("int") + 1)
    everything = Window.partitionBy()
    s = (
        sources.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
    )
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    s = s.withColumn("level", rest / F.sum("weight").over(after)).withColumn("turn", F.row_number().over(by_level))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    s = s.withColumn("first_fit", F.min(F.when(fits, F.struct("turn", "level"))).over(everything))
    free = F.col("turn") >= F.col("first_fit.turn")
    target = F.when(free, F.least("most", F.col("first_fit.level") * F.col("weight"))).otherwise(F.col("most"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def taken_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    size: words of the text, 0 for null.  A null source is a source of its
    own, after all others.  copies never exceeds ``ceil(cap)``.  A source
    without words has target 0 and no copies.  Reruns agree: order and offset
    depend on values and the seed alone.  Rows that repeat an id stand next to
    each other and get copies one by one.
    """
    key, source, text = (F.col(f"`{c}`") for c in (id_col, source_col, text_col))
    slot = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 2), 16, 10).cast("int")
    rows = docs.select(key.alias("doc_id"), source.alias("source"), words_in(text).alias("size"), slot.alias("slot"))
    rows = rows.withColumn("class", F.length(F.col("size").cast("string")) * 100 + F.substring(F.col("size").cast("string"), 1, 2).cast("int"))
    rows = written(rows, "sizes")

    blocks = rows.groupBy("source", "class", "slot").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = blocks.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)

    in_source = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    in_class = Window.partitionBy("source", "class").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("source", "class", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("class_start"))
    classes = classes.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "class", "class_start", "source_size", "target")
    starts = blocks.select("source", "class", "slot", F.coalesce(F.sum("n").over(in_class), F.lit(0)).alias("slot_start"))
    starts = (
        starts.alias("b")
        .join(classes.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.class") == F.col("c.class")))
        .select("b.source", "b.class", "slot", (F.col("class_start") + F.col("slot_start")).alias("start"), "source_size", "target")
    )
    same = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.class") == F.col("s.class")) & (F.col("r.slot") == F.col("s.slot"))
    rows = rows.alias("r").join(starts.alias("s"), same).select("doc_id", "r.source", "r.class", "r.slot", "size", "start", "source_size", "target")
    nth = F.row_number().over(Window.partitionBy("source", "class", "slot").orderBy("size", "doc_id")) + F.col("start")

    share_of = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = rows.withColumn("nth", nth).withColumn("each", share_of).withColumn("offset", drawn)
    crossed = F.floor(F.col("nth") * F.col("each") + F.col("offset")) - F.floor((F.col("nth") - 1) * F.col("each") + F.col("offset"))
    rows = rows.withColumn("copies", crossed.cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, with all their columns, whatever their names.

    Rows that repeat both id and size are taken from as a set: their copies are
    dealt over them in turn.
    """
    own_id, own_source, words, turn, nth, copies, copy, size = fresh_names(docs.columns, "id", "source", "words", "turn", "nth", "copies", "copy", "size")
    took = taken_copies(docs, id_col, text_col, source_col, **how).select(F.col("doc_id").alias(own_id), F.col("source").alias(own_source), F.col("size").alias(words), F.col("copies").alias(copies))
    took = took.withColumn(turn, F.row_number().over(Window.partitionBy(own_id, own_source, words).orderBy(F.desc(copies))))
    key, source, text = (F.col(f"`{c}`") for c in (id_col, source_col, text_col))
    rows = docs.withColumn(size, words_in(text))
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, source, size).orderBy(F.xxhash64(text))))
    same = key.eqNullSafe(F.col(own_id)) & source.eqNullSafe(F.col(own_source)) & (F.col(size) == F.col(words)) & (F.col(nth) == F.col(turn))
    rows = rows.join(took.filter(F.col(copies) > 0), same)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return rows.select([F.col(f"`{c}`") for c in docs.columns])
