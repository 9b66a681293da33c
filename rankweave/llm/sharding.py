"""Shards by jump consistent hashing.

A row's shard depends on its key and the number of shards alone.  The key seeds
a generator; its numbers say at which numbers of shards the key jumps to the
newest one, and the last jump below the number of shards is the shard.  With
more shards a key stays or goes to a new one, so only the necessary fraction
moves, and there is no table of a ring.

A row's place in its shard comes from a sort by range, so that a shard, or a
key that many rows share, spans many tasks.  Only built-in DataFrame functions
run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from .common import fresh_names, written

#: Fixed value: the multiplier of the method's generator, key -> key * MULTIPLIER + 1 modulo 2^64.
MULTIPLIER = 2862933555777941757
#: Jumps that are followed for every row; the few rows that need more follow theirs afterwards.
JUMPS = 32
LOW32, LOW16 = (1 << 32) - 1, (1 << 16) - 1


def key_halves(key: Column) -> tuple[Column, Column]:
    """The upper and the lower 32 bits of a key's 64-bit hash, as longs; null has the hash of an empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit(bits))


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Both halves of the generator's next number; no product exceeds 49 bits, so nothing overflows."""
    a = [MULTIPLIER >> at & LOW16 for at in (0, 16, 32, 48)]
    shifted = lambda x: F.shiftleft(_low(x, LOW16), 16)
    second = lo * F.lit(a[1])
    low = lo * F.lit(a[0]) + shifted(second) + 1
    carry = F.shiftright(low, 32) + F.shiftright(second, 16)
    high = carry + hi * F.lit(a[0]) + shifted(hi * F.lit(a[1])) + lo * F.lit(a[2]) + shifted(lo * F.lit(a[3]))
    return _low(high, LOW32), _low(low, LOW32)


def jumps(key: Column, shards: int) -> Column:
    """(b, j): the shard of a key among ``shards``, and the number of shards minus one at which it jumps next."""
    if shards < 1:
        raise ValueError("at least one shard")

    def follow(state: Column, _: Column) -> Column:
        hi, lo = _next(state["hi"], state["lo"])
        drawn = F.struct(hi.alias("hi"), lo.alias("lo"), state["j"].alias("b"))
        step = lambda s: F.struct(s["hi"], s["lo"], s["b"], F.floor((s["b"] + 1) * (F.lit(2.0**31) / (F.shiftright(s["hi"], 1) + 1))).cast("long").alias("j"))
        return F.when(state["j"] < shards, F.get(F.transform(F.array(drawn), step), F.lit(0))).otherwise(state)

    hi, lo = key_halves(key)
    turns = lambda first, last: F.sequence(F.lit(first), F.lit(last))
    state = F.aggregate(turns(1, min(shards, JUMPS)), F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")), follow)
    if shards > JUMPS:  # a key jumps about ln(shards) times; the turns left do nothing but for a few rows
        state = F.get(F.transform(F.array(state), lambda s: F.when(s["j"] < shards, F.aggregate(turns(JUMPS + 1, shards), s, follow)).otherwise(s)), F.lit(0))
    return F.get(F.transform(F.array(state), lambda s: F.struct(s["b"].cast("int").alias("b"), s["j"].alias("j"))), F.lit(0))


def shard_of(key: Column, shards: int) -> Column:
    return jumps(key, shards)["b"]


def placed(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: the text's bytes in UTF-8 plus one; a null text has none and the
    checksum of an empty one.  law is always ``key``.  slot counts a shard's
    rows from 0 in the order of id, size and checksum.  grown_shard: the shard
    among one more.  A null id is a key like any other.  Rows with the same id
    share a shard, whatever their texts; repeated rows take slots of their own.
    An empty table gives an empty result.  Other columns are ignored, whatever
    their names.  A text is worked on whole where it lies and doesn't move.
    """
    text = F.col(f"`{text_col}`")
    size = (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size, crc).withColumn("jump", jumps(F.col("doc_id"), shards))
    # the number tells apart rows that repeat each other, so that the sort can part them
    rows = written(rows.select("doc_id", "size", "text_crc32", F.col("jump.b").alias("shard"), F.col("jump.j").alias("next"), F.monotonically_increasing_id().alias("row")), "shards")
    rows = ranked(rows, ["shard"], ["doc_id", "size", "text_crc32", "row"], "nth")
    grown = F.when(F.col("next") == shards, F.lit(shards)).otherwise(F.col("shard"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("nth") - 1).cast("long").alias("slot"), grown.cast("int").alias("grown_shard"))


def moved(docs: DataFrame, shards: int, more: int, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that go to another shard when ``shards`` become ``more``, with all their columns; what to rewrite when an archive grows."""
    key = F.col(f"`{id_col}`")
    return docs.filter(shard_of(key, shards) != shard_of(key, more))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id") -> str:
    """Writes all columns of ``docs`` as Parquet, one folder per shard under ``path``; returns the name of the shard's column.

    Large shards are split over many tasks and files, small ones share tasks.
    """
    (name,) = fresh_names(docs.columns, "shard")
    rows = docs.withColumn(name, shard_of(F.col(f"`{id_col}`"), shards))
    rows.hint("rebalance", name).write.partitionBy(name).parquet(path)
    return name
