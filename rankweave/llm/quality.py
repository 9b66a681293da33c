"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

An interpolated modified Kneser-Ney model of n-grams (two words in the query, as three would not fit the disk that it may use)
is counted from a bounded sample of trusted texts.  Its logarithms split into a
sum of weights, one per known n-gram, so a document's score is a join of its
counts with the weights:

    log p(text) = n * log p(unknown) + log g(start)
                + sum over words w:           log p(w) - log p(unknown) + log g(w)
                + sum over longer n-grams x:  log p(last | rest) - log g(rest) - log p(last | rest without its first) + log g(x)

where g is the share that a context leaves to the shorter context's
distribution, and counts as 1 for n-grams that are no context.

Counting runs in two exchanges of packed n-grams, sharded by the last word but
one: all n-grams with the same context then lie in one shard, and so do the
shorter ones that end like them.  Only the words' own distribution is added up
across shards.

The join runs in shards of the key.  A task sends each shard its distinct keys
with the documents that hold them, packed; a fixed-size bitmap of the model's
keys, broadcast, keeps back those that no shard knows.  Weights and requests of
a shard meet sorted, weights first, so a task holds one shard of the (bounded)
model and one packet at a time, however many requests there are.

A document is kept if its perplexity doesn't exceed its language's threshold: a
quantile over trusted texts that the model hasn't seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, slices, written
from .lm_score import CHUNK_BYTES
from .ngrams import WordHashes, discounts, from_planes, hashed_texts, mixed, pack_sorted, planes, sum_by_key, unpack_sorted, word_hash

SHARDS = 8
#: Bits of a shard's part of the bitmap of known keys: 8 MB in all.
BITMAP_BITS = 23
#: Characters of text for each copy of the model among the tasks, about.
COPY_CHARS = 500_000_000
#: Bits of a key that travel: of ten million n-grams two share them with odds of 1 in 1,400, and would add up.
KEY = np.uint64((1 << 56) - 1)
START, PAD = b"\t", b"\r"
ROW_SCHEMA = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("tag", pa.int32()), *((c, pa.binary()) for c in ("keys", "pairs", "times", "weights", "ids"))])
ROW = "shard int, salt int, tag int, keys binary, pairs binary, times binary, weights binary, ids binary"
#: What fitting passes on: packed n-grams (kind 0), words with the number of contexts they follow (1, asked for by shard ``other``), and counts of counts (2).
PART_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("other", pa.int32()), ("words", pa.binary()), ("data", pa.binary()), ("counts", pa.list_(pa.int64()))])
PART = "shard int, kind int, other int, words binary, data binary, counts array<long>"


@dataclass
class Model:
    #: Rows of ROW with packed keys and weights, written in the shared folder; equal keys of several rows add up.
    weights: DataFrame
    bitmap: Broadcast
    log_unknown: float
    log_start: float
    order: int


def _longer_keys(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return first ^ ((rest << np.uint64(17)) | (rest >> np.uint64(47)))


def _cells(keys: np.ndarray) -> np.ndarray:
    """The place of each key in the bitmap."""
    return (keys & np.uint64(SHARDS - 1)) << np.uint64(BITMAP_BITS) | (keys >> np.uint64(20)) & np.uint64((1 << BITMAP_BITS) - 1)


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """The key of each row of word hashes: the first, exclusive-or the key of the rest turned by 17 bits."""
    key = grams[:, -1]
    for k in range(grams.shape[1] - 2, -1, -1):
        key = _longer_keys(grams[:, k], key)
    return key


def _summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in order, with the sums of their counts."""
    if not len(rows):
        return rows, counts
    by = np.lexsort(rows.T[::-1])
    rows, counts = rows[by], counts[by]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(1)))
    return rows[first], np.add.reduceat(counts, first)


def _packed_grams(grams: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Rows as numbers of their distinct words, in planes of bytes."""
    words, at = np.unique(grams, return_inverse=True)
    columns = np.concatenate([at.reshape(grams.shape).T, counts[None]]).astype(np.uint32)
    return zlib.compress(pack_sorted(words), 1), zlib.compress(planes(columns.reshape(-1)), 1)


def _unpacked_grams(words: bytes, data: bytes, order: int) -> tuple[np.ndarray, np.ndarray]:
    columns = from_planes(zlib.decompress(data), np.uint32).reshape(order + 1, -1)
    return unpack_sorted(zlib.decompress(words))[columns[:order].T], columns[order].astype(np.int64)


def _parts(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PART_SCHEMA)], schema=PART_SCHEMA)


def _shard_of(words: np.ndarray) -> np.ndarray:
    return (mixed(words) % np.uint64(SHARDS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of texts, the start and pads before it in front, sharded by the last word but one."""
    hashes = WordHashes()
    front = np.array([*[word_hash(PAD)] * (order - 2), word_hash(START)], np.uint64)
    for batch in slices(batches, "text", CHUNK_BYTES):
        tokens, lengths = hashed_texts(batch.column("text"), hashes)
        begin = lengths.cumsum() - lengths
        long = np.insert(tokens, np.repeat(begin, order - 1), np.tile(front, len(begin)))
        last = np.arange(len(tokens)) + np.repeat(np.arange(1, len(begin) + 1) * (order - 1), lengths)
        grams = np.stack([long[last - k] for k in range(order - 1, -1, -1)], axis=1)
        grams, counts = _summed(grams, np.ones(len(grams), np.int64))
        shard = _shard_of(grams[:, -2])
        yield from _parts([(s, 0, None, *_packed_grams(grams[shard == s], counts[shard == s]), None) for s in np.unique(shard).tolist()]).to_batches()


def _levels(grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length the n-grams with their counts: at full length how often they occur, below it how many words they follow.

    What begins with the start follows nothing and counts as often as it occurs; pads only stand in for what a text lacks.
    """
    pad, order = np.uint64(word_hash(PAD)), grams.shape[1]
    out = {}
    for n in range(order, 0, -1):
        real = grams[:, 0] != pad
        out[n] = grams[real], counts[real]
        if n > 1:
            grams, counts = _summed(grams[:, 1:], np.where(real, 1, counts))
    return out


def _merged_grams(order: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def work(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        parts = [_unpacked_grams(w.as_py(), d.as_py(), order) for w, d in zip(group.column("words"), group.column("data"))]
        grams, counts = _summed(np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts]))
        levels = _levels(grams, counts)
        rows = [(shard, 0, None, *_packed_grams(grams, counts), None)]
        rows += [(shard, 2, n, None, None, _of_counts(levels[n][1])) for n in range(2, order + 1)]
        words, follows = levels[1][0][:, 0], levels[1][1]
        own = _shard_of(words)
        rows += [(s, 1, shard, pack_sorted(words[own == s]), planes(follows[own == s].astype(np.uint32)), None) for s in np.unique(own).tolist()]
        return _parts(rows)

    return work


def _of_counts(counts: np.ndarray) -> list[int]:
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), len(counts), int(counts.sum())]


def _merged_words(key: tuple, group: pa.Table) -> pa.Table:
    """The words of a shard added up, and sent back to each shard that has them."""
    asked = [(o, unpack_sorted(w), from_planes(d, np.uint32).astype(np.int64)) for o, w, d in zip(*(group.column(c).to_pylist() for c in ("other", "words", "data")))]
    words, follows = sum_by_key(np.concatenate([w for _, w, _ in asked]), np.concatenate([f for _, _, f in asked]))
    back = [(o, 1, key[0].as_py(), pack_sorted(w), planes(follows[np.searchsorted(words, w)].astype(np.uint32)), None) for o, w, _ in asked]
    return _parts([*back, (key[0].as_py(), 2, 1, None, None, _of_counts(follows))])


def _weighed(order: int, cuts: dict[int, tuple[float, float, float]], many: float, unknown: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """Weights of a shard's n-grams, by shard of the key; those of a context lie in the shard of its last word, and are added to its own when they are used."""

    def work(key: tuple, group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        some = lambda k: group.filter(pa.array(kind == k)).to_pylist()
        told = some(1)
        words, follows = np.concatenate([unpack_sorted(r["words"]) for r in told]), np.concatenate([from_planes(r["data"], np.uint32) for r in told]).astype(np.int64)
        by = np.argsort(words)
        words, follows = words[by], follows[by]
        less = lambda c, n: np.array([0.0, *cuts[n]])[np.minimum(c, 3)]
        below_grams, below = words[:, None], (follows - less(follows, 1)) / many + unknown
        keys, weights = [], []
        levels = _levels(*_unpacked_grams(some(0)[0]["words"], some(0)[0]["data"], order))
        for n in range(2, order + 1):
            grams, counts = levels[n]
            if not len(grams):
                break  # texts of this shard's words are all shorter
            context = np.append(True, (grams[1:, :-1] != grams[:-1, :-1]).any(1))
            first = np.flatnonzero(context)
            of = context.cumsum() - 1
            total, spare = np.add.reduceat(counts, first), np.add.reduceat(less(counts, n), first)
            g = spare / total
            rest = below[_places(below_grams, grams[:, 1:])]
            p = (counts - less(counts, n)) / total[of] + g[of] * rest
            keys += [gram_keys(grams), gram_keys(grams[first, :-1])]
            weights += [np.log10(p) - np.log10(g[of]) - np.log10(rest), np.log10(g)]
            below_grams, below = grams, p
        return _weights_by_key(np.concatenate(keys), np.concatenate(weights))

    return work


def _places(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted row stands among the distinct ``rows``, which hold all of them."""
    keys = gram_keys(rows)
    by = np.argsort(keys)
    return by[np.searchsorted(keys[by], gram_keys(wanted))]


def _weights_by_key(keys: np.ndarray, weights: np.ndarray) -> pa.Table:
    keys, weights = sum_by_key(keys & KEY, weights)
    shard = (keys & np.uint64(SHARDS - 1)).astype(np.int64)
    rows = [(s, 0, 0, zlib.compress(pack_sorted(keys[shard == s]), 1), None, None, planes(weights[shard == s].astype(np.float32)), None) for s in np.unique(shard).tolist()]
    return pa.table([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(ROW_SCHEMA)], schema=ROW_SCHEMA)


def _word_weights(cut: tuple[float, float, float], many: float, unknown: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def work(key: tuple, group: pa.Table) -> pa.Table:
        words, follows = (np.concatenate(x) for x in zip(*[(unpack_sorted(w), from_planes(d, np.uint32).astype(np.int64)) for w, d in zip(*(group.column(c).to_pylist() for c in ("words", "data")))]))
        words, first = np.unique(words, return_index=True)
        follows = follows[first]
        p = (follows - np.array([0.0, *cut])[np.minimum(follows, 3)]) / many + unknown
        return _weights_by_key(words, np.log10(p) - np.log10(unknown))

    return work


def fit(trusted: DataFrame, text_col: str = "text", order: int = 3) -> Model:
    """The model of the texts of ``trusted``, all of them; a null text is an empty one."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = trusted.sparkSession
    texts = trusted.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    grams = written(texts.mapInArrow(lambda it: _counted(it, order), PART).groupBy("shard").applyInArrow(_merged_grams(order), PART), "grams")
    words = written(grams.filter("kind = 1").groupBy("shard").applyInArrow(_merged_words, PART), "words")
    of = {n: np.zeros(6, np.int64) for n in range(1, order + 1)}
    for r in grams.filter("kind = 2").unionByName(words.filter("kind = 2")).select("other", "counts").collect():  # a row per shard and length
        of[r["other"]] += np.array(r["counts"])
    cuts = {n: discounts(*(int(x) for x in c[:4])) for n, c in of.items()}
    n1, n2, _, _, distinct, total = (int(x) for x in of[1])
    many = float(max(total, 1))
    spare = (cuts[1][0] * n1 + cuts[1][1] * n2 + cuts[1][2] * (distinct - n1 - n2)) / many if distinct else 1.0
    unknown = spare / (distinct + 1)

    whole = grams.filter("kind = 0").unionByName(words.filter("kind = 1"))
    longer = whole.groupBy("shard").applyInArrow(_weighed(order, cuts, many, unknown), ROW)
    single = words.filter("kind = 1").groupBy(F.col("other").alias("by")).applyInArrow(_word_weights(cuts[1], many, unknown), ROW)
    weights = written(longer.unionByName(single), "weights")

    known = weights.select("shard", "keys").groupBy("shard").applyInArrow(_bits, "shard int, bits binary").toArrow()  # a megabyte a shard
    bitmap = np.zeros((SHARDS, 1 << (BITMAP_BITS - 3)), np.uint8)
    for shard, bits in zip(known["shard"].to_pylist(), known["bits"].to_pylist()):
        bitmap[shard] = np.frombuffer(bits, np.uint8)
    start = _start_share(weights) if distinct else 0.0
    return Model(weights, spark.sparkContext.broadcast(bitmap.reshape(-1)), float(np.log10(unknown)), start, order)


def _bits(key: tuple, group: pa.Table) -> pa.Table:
    """A shard's part of the bitmap."""
    bits = np.zeros(1 << BITMAP_BITS, bool)
    for keys in group.column("keys"):
        bits[_cells(unpack_sorted(zlib.decompress(keys.as_py()))) & np.uint64((1 << BITMAP_BITS) - 1)] = True
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _start_share(weights: DataFrame) -> float:
    """The weight of the start itself: it is a context only."""
    start = word_hash(START)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, weight in zip(batch.column("keys"), batch.column("weights")):
                k, w = unpack_sorted(zlib.decompress(keys.as_py())), from_planes(weight.as_py(), np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(w[k == np.uint64(start) & KEY].astype(np.float64))], names=["weight"])

    own = weights.filter(F.col("shard") == start % SHARDS).mapInArrow(work, "weight double")
    return own.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()["w"]


def _requests(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray, order: int, salts: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    start = np.uint64(word_hash(START))
    for batch in slices(batches, "text", CHUNK_BYTES):
        ids = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("k", "l")])
        tokens, lengths = hashed_texts(batch.column("text"), hashes)
        place = np.arange(len(tokens)) - np.repeat(lengths.cumsum() - lengths, lengths)
        every = np.repeat(np.arange(len(batch), dtype=np.uint64), lengths)
        keys, doc, key = [tokens], [every], tokens
        for n in range(2, order + 1):  # n-grams that end at each token; the start may stand first
            first = np.append(np.full(n - 1, start), tokens)[: len(tokens)]
            key = _longer_keys(np.where(place == n - 2, start, first), key)
            inside = place >= n - 2
            keys.append(key[inside])
            doc.append(every[inside])
        keys, doc = np.concatenate(keys), np.concatenate(doc)
        cell = _cells(keys)
        known = bitmap[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1 == 1
        distinct, place = np.unique(keys[known] & KEY, return_inverse=True)
        # one number for key and document together: both are small now
        rows_of = np.uint64(len(batch))
        both, times = np.unique(place.astype(np.uint64) * rows_of + doc[known], return_counts=True)
        place, doc = (both // rows_of).astype(np.int64), both % rows_of
        shard = (distinct & np.uint64(SHARDS - 1)).astype(np.int64)
        salt = int(ids[0, 0]) % salts
        rows = []
        for s in range(SHARDS):
            own = shard == s
            if not own.any():
                continue
            of = own[place]
            # keys by their number within the shard, so that the pairs lie as close as they can
            pairs = (own.cumsum() - 1)[place[of]].astype(np.uint64) * rows_of + doc[of]
            packed = (pack_sorted(distinct[own]), pack_sorted(pairs), planes(times[of].astype(np.uint32)))
            rows.append((s, salt, 1, *(zlib.compress(x, 1) for x in packed), None, ids.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(ROW_SCHEMA)], schema=ROW_SCHEMA)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, told, known, weights = None, [], np.empty(0, np.uint64), np.empty(0)
    for batch in batches:
        for i in range(len(batch)):  # one packet at a time: together they are large
            row = batch.slice(i, 1).to_pylist()[0]
            if at != (row["shard"], row["salt"]):
                at, told, known, weights = (row["shard"], row["salt"]), [], np.empty(0, np.uint64), np.empty(0)
            if row["tag"] == 0:
                told.append((unpack_sorted(zlib.decompress(row["keys"])), from_planes(row["weights"], np.float32).astype(np.float64)))
                continue
            if told:
                known, weights = sum_by_key(*(np.concatenate(x) for x in zip(*told)))
                told = []
            if not len(known):
                continue  # no word of the model falls in this shard
            keys = unpack_sorted(zlib.decompress(row["keys"]))
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            weight = np.where(known[place] == keys, weights[place], 0.0)
            ids = np.frombuffer(row["ids"], np.int64).reshape(2, -1)
            pairs, times = unpack_sorted(zlib.decompress(row["pairs"])), from_planes(zlib.decompress(row["times"]), np.uint32)
            of, doc = np.divmod(pairs, np.uint64(ids.shape[1]))
            sums = np.bincount(doc.astype(np.int64), weights=weight[of.astype(np.int64)] * times, minlength=ids.shape[1])
            some = sums != 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[0, some]), pa.array(ids[1, some]), pa.array(sums[some])], names=["k", "l", "part"])


def perplexity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens (words and one end) and perplexity of each whole text.

    A null text is an empty one.  Repeated rows get equal values.  An empty
    table gives an empty result.  Columns of ``docs`` named like the two new
    ones must not be kept; others may have any name.  A text is worked on
    whole: a task needs about 100 bytes for each of its words.
    """
    keep = docs.columns if keep is None else keep
    if clash := {"n_tokens", "perplexity"} & {c.lower() for c in keep}:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in keep]
    # rows are told apart by two hashes of 64 bits; the columns that are kept travel within one
    rows = docs.select(F.struct(*kept).alias("row") if kept else F.lit(None).cast("int").alias("row"), F.xxhash64(*kept, text).alias("k"), F.xxhash64(F.lit(1), *kept, F.reverse(text)).alias("l"), text.alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    salts = max(1, -(-chars // COPY_CHARS))
    bitmap, order = model.bitmap, model.order
    asked = rows.select("k", "l", "text").mapInArrow(lambda it: _requests(it, bitmap.value, order, salts), ROW)
    own = model.weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(asked.columns)
    met = own.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "tag")
    sums = met.mapInArrow(_answers, "k long, l long, part double").groupBy("k", "l").agg(F.sum("part").alias("part"))

    about = written(rows.select("row", "k", "l", (F.regexp_count("text", F.lit(WORD)) + 1).cast("long").alias("n_tokens")), "tokens")
    copies = about.groupBy("k", "l").agg(F.count("*").alias("copies")).filter("copies > 1")
    out = about.join(sums, ["k", "l"], "left").join(copies, ["k", "l"], "left")
    log = F.coalesce("part", F.lit(0.0)) / F.coalesce("copies", F.lit(1)) + F.lit(model.log_start) + F.lit(model.log_unknown) * F.col("n_tokens")
    return out.select(*[F.col(f"row.`{c}`") for c in keep], "n_tokens", F.pow(F.lit(10.0), -log / F.col("n_tokens")).alias("perplexity"))


def draw_of(id_col: str) -> Column:
    """A number from 0 to 1 by the hash of an id."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))


def trusted_parts(trusted: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", most_docs: int = 12_000, most_chars: int = 20_000) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows to learn from, and what picks the rows that set thresholds.

    A hash of the id sets a fifth of each language's rows apart for the
    thresholds, one id at least, and draws about ``most_docs`` of the others,
    none longer than ``most_chars``, for the model, so that the model's size
    has a bound.
    """
    draw, lang = draw_of(id_col), F.col(f"`{lang_col}`")
    first = trusted.groupBy(lang.alias("of")).agg(F.min(draw).alias("first"))
    is_judge = (draw < 0.2) | (draw == F.col("first"))

    def judges(rows: DataFrame) -> DataFrame:
        return rows.join(first, lang.eqNullSafe(F.col("of"))).filter(is_judge).drop("of", "first")

    n = trusted.count()
    part = min(1.0, most_docs / (0.8 * n)) if n else 1.0
    fits = (draw < 0.2 + 0.8 * part) & (F.coalesce(F.char_length("text"), F.lit(0)) <= most_chars)
    learn = trusted.join(first, lang.eqNullSafe(F.col("of"))).filter(~is_judge & fits).drop("of", "first")
    return learn, judges


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, slack: float = 1.25, order: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, n_tokens, perplexity, threshold, kept.

    Trusted are the rows whose id ``labels`` gives quality 1 (an id that has
    other labels too counts once).  The threshold of a language is ``slack``
    times the ``quantile`` of the perplexities of its trusted rows that the
    model hasn't learned; a perplexity equal to it is kept.  A language without
    trusted rows has no threshold, and keeps all.  A null language is one of
    its own.  An empty table gives an empty result; without labels all is kept.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good")).distinct()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    learn, judges = trusted_parts(rows.join(good, F.col("doc_id") == F.col("good"), "left_semi"))
    scored = written(perplexity(rows, fit(learn, order=order), keep=["doc_id", "lang"]), "perplexities")
    judged = judges(scored.join(good, F.col("doc_id") == F.col("good"), "left_semi"))
    limits = judged.groupBy(F.col("lang").alias("of")).agg((F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * F.lit(slack)).alias("threshold"))
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
