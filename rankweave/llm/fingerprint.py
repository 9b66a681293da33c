"""SimHash fingerprints and the search for fingerprints within a Hamming radius.

A document's terms are its pairs of adjacent words, after lower-casing.  Each
occurrence of a term votes on the 64 bits of the term's hash, for a set bit and
against an unset one, with the number of its characters as weight (long words
are rare ones).  A bit of the fingerprint is set if more weight votes for it
than against it.

Search: the 64 bits are cut into ``radius + 3`` blocks.  Two fingerprints
within the radius differ in at most ``radius`` blocks, so they agree on three
whole ones at least.  There is one table for each choice of three blocks, keyed
by the bits of these blocks alone; equal keys make candidates, and a candidate
counts in the first table that holds it and only if it is within the radius.

Only built-in DataFrame functions run.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, each_slot, occupied, slot_of, written

BITS = 64
#: Sums of weights need no more bits than these: a text's characters count twice at most.
LANES = 32


def _terms(text: Column) -> Column:
    """Array of (a, b): each word with its successor, null after the last."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def simhash(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per distinct ``keys`` with column fp (long); texts that share keys vote together.

    A null or blank text has no terms and gets fingerprint 0.
    """
    term = texts.select(*keys, F.explode_outer(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term"))
    weight = (F.coalesce(F.char_length("term.a"), F.lit(0)) + F.coalesce(F.char_length("term.b"), F.lit(0))).cast("long")
    term = term.select(*keys, weight.alias("w"), F.xxhash64("term.a", "term.b").alias("x"))
    # one long holds the votes for bit i in its low half and for bit i + 32 in its high half
    lane = F.lit((1 << LANES) + 1)
    sums = [F.sum(F.shiftrightunsigned("x", i).bitwiseAND(lane) * F.col("w")).alias(f"s{i}") for i in range(LANES)]
    votes = term.groupBy(*keys).agg(F.sum("w").alias("all"), *sums)
    low = [F.when(F.col(f"s{i}").bitwiseAND(F.lit((1 << LANES) - 1)) * 2 > F.col("all"), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(LANES)]
    high = [F.when(F.shiftrightunsigned(f"s{i}", LANES) * 2 > F.col("all"), F.lit((1 << (i + LANES)) - (1 << BITS) * (i + LANES == 63))).otherwise(F.lit(0)).cast("long") for i in range(LANES)]
    return votes.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), low + high).alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 minus the share of differing bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_masks(radius: int, keep: int = 3) -> list[int]:
    """One signed 64-bit mask per choice of ``keep`` of ``radius + keep`` blocks."""
    n = radius + keep
    edges = [round(i * BITS / n) for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, keep)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, within_radius): for each fingerprint of ``queries``, the documents within ``radius`` bits of it.

    ``queries`` has distinct fp; ``fingerprints`` has distinct fp and ``docs``,
    the documents that share it.  The query's own documents count too.
    """
    masks = block_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("mask")) for t, m in enumerate(masks)]))
    keyed = lambda df: df.withColumn("table", tables).withColumn("key", F.col("fp").bitwiseAND(F.col("table.mask"))).withColumn("t", F.col("table.t"))
    q = keyed(queries.select("fp")).select(F.col("fp").alias("q"), "t", "key")
    f = keyed(fingerprints.select("fp", "docs")).select("fp", "docs", "t", "key")
    differ = F.col("q").bitwiseXOR(F.col("fp"))
    first = reduce(lambda rest, x: F.when(differ.bitwiseAND(F.lit(x[1])) == 0, F.lit(x[0])).otherwise(rest), reversed(list(enumerate(masks))), F.lit(-1))
    on = (q["t"] == f["t"]) & (q["key"] == f["key"]) & (F.bit_count(differ) <= radius) & (first == q["t"])
    return q.join(f, on).groupBy(F.col("q").alias("fp")).agg(F.sum("docs").alias("within_radius"))


def followers(ids: DataFrame) -> DataFrame:
    """(doc_id, h, n, next_id, next_h): the successor of each distinct (doc_id, h) in order of descending doc_id, then h; the last is followed by the first.

    A distributed sort numbers the rows; a row's successor has the next number
    of its partition, or is the first row of the next partition that has any.
    """
    order = ids.orderBy(F.col("doc_id").desc_nulls_last(), "h")
    at = written(order.withColumn("at", F.monotonically_increasing_id()), "order")
    ends = at.groupBy(F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    every = Window.orderBy("part")  # a row per partition of the sort
    ends = ends.select(
        "last",
        F.coalesce(F.lead("first").over(every), F.min("first").over(Window.partitionBy())).alias("then"),
    )
    at = at.join(F.broadcast(ends), at["at"] == ends["last"], "left").select("doc_id", "h", "n", "at", F.coalesce("then", F.col("at") + 1).alias("then"))
    after = at.select(F.col("at").alias("then"), F.col("doc_id").alias("next_id"), F.col("h").alias("next_h"))
    return written(at.join(after, "then").select("doc_id", "h", "n", "next_id", "next_h"), "followers")


def key_of(id_col: str) -> Column:
    """An integer id as a value that joins and windows alike can use as key, so that they share one shuffle; null has its own."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def spliced(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, h, text, edited): the last third of each text replaced by as much of its successor's beginning.

    ``docs`` has distinct (key, h).  A successor sends only the beginning that
    is asked for.
    """
    asked = pairs.select(key_of("next_id").alias("key"), F.col("next_h").alias("h"), key_of("doc_id").alias("to_key"), F.col("h").alias("to_h"), F.floor(F.col("n") / 3).cast("int").alias("k"))
    sent = docs.join(asked, ["key", "h"]).select(F.col("to_key").alias("key"), F.col("to_h").alias("h"), "k", F.left("text", F.col("k")).alias("head"))
    return docs.join(sent, ["key", "h"]).select("key", "h", "text", F.concat(F.left("text", F.char_length("text") - F.col("k")), "head").alias("edited"))


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, query_every: int = 50) -> DataFrame:
    """One row per row of ``docs`` with fingerprints of its text and of its edited text.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and within_radius (documents, itself included, whose
    fingerprint is within ``radius`` bits; null unless doc_id is divisible by
    ``query_every``).  A null text counts as empty.  Rows that repeat both id
    and text are one step of the order and get equal results; rows that share
    an id only follow each other by a hash of the text.  A null id comes last.
    A single row follows itself.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.  A text is worked on whole: its
    pairs of words leave one row each, and are added up where they arise.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ids = written(rows.select("doc_id", "h", F.char_length("text").cast("long").alias("n")), "ids")
    copies = ids.groupBy("doc_id", "h", "n").agg(F.count("*").alias("copies"))
    pairs = followers(copies.select("doc_id", "h", "n"))
    keyed = rows.select(key_of("doc_id").alias("key"), "h", "text")
    one = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key", "h").orderBy(F.lit(0)))).filter("nth = 1").drop("nth")

    sides = spliced(one, pairs).select(
        "key",
        "h",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.lit(None).cast("binary").alias("sha"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.col("edited").alias("t")))).alias("s"),
    )
    sides = sides.select("key", "h", "s.side", "s.sha", F.col("s.t").alias("text"))
    fps = written(simhash(sides, ["key", "h", "side", "sha"], "text"), "fingerprints")

    own = fps.filter("side = 0").select("key", "h", F.col("fp").alias("own"))
    edited = fps.filter("side = 1").select("key", "h", F.lower(F.hex("sha")).alias("edited_sha256"), F.col("fp").alias("changed"))
    after = own.select(F.col("key").alias("next_key"), F.col("h").alias("next_h"), F.col("own").alias("after"))
    out = pairs.select("doc_id", key_of("doc_id").alias("key"), "h", "n", key_of("next_id").alias("next_key"), "next_h")
    out = out.join(own, ["key", "h"]).join(edited, ["key", "h"])
    out = out.join(copies.select(key_of("doc_id").alias("key"), "h", "copies"), ["key", "h"]).join(after, ["next_key", "next_h"])
    out = out.select("doc_id", "n", "own", "edited_sha256", "changed", "after", "copies")
    out = written(out, "results")

    # only the rows that ask meet the answers, and rows that share a fingerprint stay dealt out
    table = out.groupBy(F.col("own").alias("fp")).agg(F.sum("copies").alias("docs"))
    asks = F.coalesce(F.col("doc_id") % query_every == 0, F.lit(False))
    asking = out.filter(asks).withColumn("slot", slot_of("doc_id"))
    asked = asking.groupBy(F.col("own").alias("fp")).agg(occupied("slot").alias("slots"))
    near = within_radius(asked.select("fp"), table, radius).join(asked, "fp").select(F.col("fp").alias("own"), "within_radius", each_slot("slots").alias("slot"))
    answered = asking.join(near, ["own", "slot"]).drop("slot")
    out = answered.unionByName(out.filter(~asks), allowMissingColumns=True)
    return out.select(
        "doc_id",
        F.col("n").alias("n_chars"),
        "edited_sha256",
        as_hex(F.col("own")).alias("fingerprint"),
        as_hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("after")).alias("near_next"),
        "within_radius",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_nth"),
    ).drop("_nth")
