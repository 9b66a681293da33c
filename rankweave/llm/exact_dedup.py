"""Exact deduplication with a heavy-hitter split.

1. Every row's text is hashed once; id and digest are written out.
2. A frequent-items sketch (the Misra-Gries family: bounded counters, merged
   across tasks) proposes the digests that may hold more than
   ``1 / max_heavy`` of all rows.  At most ``max_heavy`` can.
3. Their exact sizes and winners are counted with map-side combining and
   broadcast (at most ``max_heavy`` rows), so their rows never shuffle.
4. All other digests take an ordinary shuffle of id and digest.  Their groups
   are counted with map-side combining too, and the rows of a group stay dealt
   over many slots, so a group below the heavy ones' size isn't one task's.

Only built-in DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import each_slot, fresh_names, lower_ascii, occupied, slot_of, written


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def heavy_digests(ids: DataFrame, max_heavy: int, tracked: int) -> DataFrame:
    """(digest) of every digest the sketch can't rule out to exceed 1/max_heavy of the rows; at most max_heavy rows."""
    found = ids.agg(F.expr(f"approx_top_k(digest, {max_heavy}, {tracked})").alias("top"), F.count("*").alias("n"))
    each = found.select("n", F.explode("top").alias("one"))
    return each.filter((F.col("one.count") >= 2) & (F.col("one.count") * max_heavy >= F.col("n"))).select(F.col("one.item").alias("digest"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = 1000, tracked: int = 16384) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  The row with the
    largest id of a group stays.  A null text counts as empty; null ids rank
    below all others.  Of repeated rows with the same id and text exactly one
    is kept.  An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    ids = written(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_digest(F.col(f"`{text_col}`")).alias("digest")), "digests")
    proposed = heavy_digests(ids, max_heavy, tracked)
    winners = written(
        ids.join(F.broadcast(proposed), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")),
        "winners",
    )

    light = ids.join(F.broadcast(winners), "digest", "left_anti").withColumn("slot", slot_of("doc_id"))
    parts = light.groupBy("digest", "slot").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = parts.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), occupied("slot").alias("slots"))
    groups = groups.select("digest", "keep_id", "group_size", each_slot("slots").alias("slot"))
    every = ids.join(F.broadcast(winners), "digest").unionByName(light.join(groups, ["digest", "slot"]).drop("slot"))

    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    losers = every.filter(~stays).withColumn("kept", F.lit(False))
    # rows that repeat the winner's id and text are counted, not gathered; one of them is kept
    top = every.filter(stays).groupBy("doc_id", "digest", "keep_id", "group_size").agg(F.count("*").alias("same"))
    top = top.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))).alias("nth")).withColumn("kept", F.col("nth") == 1)
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")]
    return losers.select(out).unionByName(top.select(out))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; see ``duplicate_groups``."""
    digest, nth, kept_id, kept_digest = fresh_names(docs.columns, "digest", "nth", "kept_id", "kept_digest")
    kept = duplicate_groups(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_digest))
    rows = docs.withColumn(digest, text_digest(F.col(f"`{text_col}`")))
    once = Window.partitionBy(f"`{id_col}`", digest).orderBy(F.lit(0))
    rows = rows.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest))
    return rows.join(kept, same, "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
