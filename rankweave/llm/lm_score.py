"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark, in three exchanges of packed arrays, each sharded
evenly by hash so that no frequent word gathers in one task:

1. words: every task counts its words' hashes; each shard (a range of hashes)
   adds them up and writes a sorted array of hashes with its counts.  A word's
   id is its place in all these arrays together.
2. bigrams: every task counts pairs of ids; each shard (by a mix of the pair)
   adds them up and writes a sorted array of pairs with its counts, and passes
   on how many contexts each word follows and how many pairs of count 1, 2 and
   more each context has.
3. these are added up per range of ids, and written beside the word arrays.

Scoring maps the arrays into each worker's memory and looks up the distinct
words and pairs of each batch in sorted order; the workers of a machine share
the pages that they touch.  Where the shared folder is no mounted file system,
a worker reads the arrays that it needs and keeps those it used last, up to a
fixed size.  Files appear whole or not at all, and a task that runs again
replaces them with the same bytes.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_path, slices, written
from .ngrams import WordHashes, discounts, from_planes, hashed_texts, mixed, pack_sorted, planes, sum_by_key, unpack_sorted

#: Bytes of text that are worked on together, about.
CHUNK_BYTES = 6_000_000
#: Characters of training text for each shard, about, and the least number of shards.
SHARD_CHARS = 32_000_000
LEAST_SHARDS = 16

_PACKED = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_MADE = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("n3", pa.int64()), ("n4", pa.int64()), ("ids", pa.binary()), ("values", pa.binary())])


def _spark_schema(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


#: Bytes of arrays that a worker keeps where it can't map them.
KEPT_BYTES = 256_000_000
_kept: OrderedDict[str, np.ndarray] = OrderedDict()


def write_array(path: str, values: np.ndarray) -> None:
    """Write a file that appears whole or not at all; another task's file of the same name holds the same bytes."""
    fs, at = pafs.FileSystem.from_uri(path)
    if not isinstance(fs, pafs.LocalFileSystem):  # such a store shows a file when it is closed, and replaces it as one
        with fs.open_output_stream(at, compression=None) as f:
            f.write(np.ascontiguousarray(values).data)
        return
    part = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as f:
        f.write(np.ascontiguousarray(values).data)
    fs.move(part, at)


def map_array(path: str, dtype: type) -> np.ndarray:
    """The array in a file, mapped into memory, or read where it can't be mapped."""
    fs, at = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(at, dtype, "r") if fs.get_file_info(at).size else np.empty(0, dtype)
    if path not in _kept:
        with fs.open_input_stream(at, compression=None) as f:
            _kept[path] = np.frombuffer(f.read(), dtype)
        while len(_kept) > 1 and sum(x.nbytes for x in _kept.values()) > KEPT_BYTES:
            _kept.popitem(last=False)
    _kept.move_to_end(path)
    return _kept[path]


@dataclass
class Model:
    path: str
    shards: int
    #: Words in each shard, so the id of a shard's first word is the sum before it.
    sizes: list[int] = field(default_factory=list)
    tokens: int = 0
    texts: int = 0
    pairs: int = 0
    #: Shards that hold any pair.
    paired: frozenset[int] = frozenset()
    #: Discounts of pairs, and of words by the number of contexts they follow.
    high: tuple[float, float, float] = (0.5, 1.0, 1.5)
    low: tuple[float, float, float] = (0.5, 1.0, 1.5)
    #: The share of the words' mass that is spread evenly.
    spare: float = 1.0
    #: The share of the start's mass that goes to the words' distribution.
    start_spare: float = 0.0

    @property
    def words(self) -> int:
        return sum(self.sizes)


class Words:
    """The word arrays of a model, mapped on first use."""

    def __init__(self, model: Model):
        self.model = model
        self.base = np.append(0, np.cumsum(model.sizes, dtype=np.int64))
        self.bits = np.uint64(64 - (model.shards - 1).bit_length())
        self.arrays: dict[tuple[str, int], np.ndarray] = {}

    def array(self, name: str, shard: int, dtype: type) -> np.ndarray:
        if (k := (name, shard)) in self.arrays:
            return self.arrays[k]
        found = map_array(f"{self.model.path}/{name}-{shard}", dtype)
        if isinstance(found, np.memmap):
            self.arrays[k] = found
        return found

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The id of each of the ascending ``hashes``, -1 for unknown words."""
        out = np.full(len(hashes), -1, np.int64)
        cuts = np.searchsorted(hashes, np.arange(self.model.shards, dtype=np.uint64) << self.bits)
        for s, (i, j) in enumerate(zip(cuts, [*cuts[1:], len(hashes)])):
            if i < j and self.model.sizes[s]:
                own = self.array("hash", s, np.uint64)
                at = np.minimum(np.searchsorted(own, hashes[i:j]), len(own) - 1)
                out[i:j] = np.where(own[at] == hashes[i:j], at + self.base[s], -1)
        return out

    def take(self, name: str, ids: np.ndarray, dtype: type) -> np.ndarray:
        """The values of array ``name`` at the ascending ``ids``."""
        out = np.zeros(len(ids), dtype)
        cuts = np.searchsorted(ids, self.base)
        for s, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                out[i:j] = self.array(name, s, dtype)[ids[i:j] - self.base[s]]
        return out


def _shards_of(chars: int) -> int:
    n = max(LEAST_SHARDS, -(-chars // SHARD_CHARS))
    return 1 << (n - 1).bit_length()


def _chunks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    known = WordHashes()
    for part in slices(batches, column, CHUNK_BYTES):
        yield hashed_texts(part.column(column), known)


def _packed(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """Ascending keys with counts as one row per shard that has any."""
    by = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[by], np.arange(shards + 1))
    rows = [(s, by[i:j]) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([pack_sorted(keys[x]) for _, x in rows], pa.binary()), pa.array([planes(counts[x].astype(np.uint32)) for _, x in rows], pa.binary())], schema=_PACKED)


def _made(shard: int, kind: str, n: int = 0, total: int = 0, counts: tuple[int, ...] = (0, 0, 0, 0), ids: bytes = b"", values: bytes = b"") -> tuple:
    return shard, kind, n, total, *counts, ids, values


def _made_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MADE)], schema=_MADE)


def _added(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = [unpack_sorted(x.as_py()) for x in group.column("keys")]
    counts = [from_planes(x.as_py(), np.uint32).astype(np.int64) for x in group.column("counts")]
    return sum_by_key(np.concatenate(keys), np.concatenate(counts))


def _of_counts(counts: np.ndarray) -> tuple[int, ...]:
    return tuple(int((counts == k).sum()) for k in (1, 2, 3, 4))


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    bits = np.uint64(64 - (shards - 1).bit_length())
    for tokens, _ in _chunks(batches, "text"):
        keys, counts = np.unique(tokens, return_counts=True)
        yield _packed((keys >> bits).astype(np.int64), keys, counts, shards)


def _write_words(path: str) -> Callable[[tuple, pa.Table], pa.Table]:
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        keys, counts = _added(group)
        write_array(f"{path}/hash-{shard}", keys)
        write_array(f"{path}/count-{shard}", counts.astype(np.uint64))
        return _made_table([_made(shard, "words", len(keys), int(counts.sum()))])

    return merge


def _pair_ids(words: Words, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes' ids and each token's place among them; each token's id and that of what it follows (the start: the number of words)."""
    distinct, place = np.unique(tokens, return_inverse=True)
    ids = words.ids(distinct)
    word = ids[place]
    before = np.append(0, word[:-1])
    before[lengths.cumsum() - lengths] = words.model.words
    return ids, place, word, before


def _count_pairs(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    words, width = Words(model), np.uint64(model.words + 1)
    for tokens, lengths in _chunks(batches, "text"):
        _, _, word, before = _pair_ids(words, tokens, lengths)
        keys, counts = np.unique(before.astype(np.uint64) * width + word.astype(np.uint64), return_counts=True)
        yield _packed((mixed(keys) % np.uint64(model.shards)).astype(np.int64), keys, counts, model.shards)


def _write_pairs(model: Model) -> Callable[[tuple, pa.Table], pa.Table]:
    width = np.uint64(model.words + 1)

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        words = Words(model)
        keys, counts = _added(group)
        big = counts >= 255
        write_array(f"{model.path}/pair-{shard}", keys)
        write_array(f"{model.path}/pairs-{shard}", np.where(big, 255, counts).astype(np.uint8))
        write_array(f"{model.path}/bigpair-{shard}", keys[big])
        write_array(f"{model.path}/bigpairs-{shard}", counts[big].astype(np.uint64))
        rows = [_made(shard, "pairs", len(keys), int(counts.sum()), _of_counts(counts))]
        before, word = (keys // width).astype(np.int64), (keys % width).astype(np.int64)
        # a word that occurs once follows one context, and is followed once: no need to tell
        rank = np.minimum(counts, 3)
        ids, *by_rank = sum_by_key(before, *((rank == k).astype(np.int64) for k in (1, 2, 3)))
        rows += _told(model, words, "contexts", ids, np.stack(by_rank) if by_rank else np.zeros((3, 0), np.int64))
        ids, follows = sum_by_key(word, np.ones(len(word), np.int64))
        rows += _told(model, words, "follows", ids, follows[None])
        return _made_table(rows)

    return merge


def _told(model: Model, words: Words, kind: str, ids: np.ndarray, values: np.ndarray) -> list[tuple]:
    """One row per range of ids for what is known of ``ids``, without words that occur once; the start is told of as the last range's."""
    inside = ids < model.words
    often = np.ones(len(ids), bool)
    often[inside] = words.take("count", ids[inside], np.uint64) > 1
    ids, values = ids[often], values[:, often]
    cuts = np.searchsorted(ids, words.base)
    cuts[-1] = len(ids)
    return [_made(s, kind, ids=pack_sorted(ids[i:j].astype(np.uint64)), values=planes(np.ascontiguousarray(values[:, i:j]).astype(np.uint32).reshape(-1))) for s, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]


def _write_stats(model: Model) -> Callable[[tuple, pa.Table], pa.Table]:
    def merge(key: tuple, group: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        words = Words(model)
        size, base = model.sizes[shard], int(words.base[shard])
        counts = words.take("count", np.arange(base, base + size), np.uint64).astype(np.int64)
        once = counts == 1
        seen = np.zeros((3, size + 1), np.int64)
        follows = np.zeros(size + 1, np.int64)
        seen[0, :size] = once
        follows[:size] = once
        for kind, ids, values in zip(*(group.column(c).to_pylist() for c in ("kind", "ids", "values"))):
            if kind not in ("contexts", "follows"):
                continue
            at = unpack_sorted(ids).astype(np.int64) - base
            at = np.where(at + base == model.words, size, at)
            told = from_planes(values, np.uint32).astype(np.int64).reshape(-1, len(at))
            if kind == "contexts":
                seen[:, at] += told
            else:
                follows[at] += told[0]
        spare = np.array(model.high) @ seen
        follows = follows[:size]
        write_array(f"{model.path}/follow-{shard}", follows.astype(np.uint64))
        write_array(f"{model.path}/spare-{shard}", (spare[:size] / np.maximum(counts, 1)).astype(np.float32))
        return _made_table([_made(shard, "stats", int((follows >= 3).sum()), int(round(spare[size] * 1e6)), _of_counts(follows))])

    return merge


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A model of all whole texts of ``docs``; a null text is an empty one, and an empty table makes a model that knows no word."""
    docs = docs.select(F.col(text_col).alias("text"))
    spark = docs.sparkSession
    about = docs.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"), F.count(F.lit(1)).alias("n")).first()
    path = new_path(spark, "lm")
    shards = _shards_of(about["chars"])
    model = Model(path, shards, [0] * shards, texts=about["n"])
    pafs.FileSystem.from_uri(path)[0].create_dir(pafs.FileSystem.from_uri(path)[1])
    packed, made = _spark_schema(_PACKED), _spark_schema(_MADE)

    counted = docs.mapInArrow(lambda it: _count_words(it, shards), packed)
    for r in counted.groupBy("shard").applyInArrow(_write_words(path), made).select("shard", "n", "total").collect():
        model.sizes[r["shard"]] = r["n"]
        model.tokens += r["total"]
    if not model.tokens:
        return model

    if (model.words + 1) ** 2 > 1 << 64:
        raise OverflowError("a pair's key has 64 bits: at most 4,294,967,294 distinct words")
    paired = docs.mapInArrow(lambda it: _count_pairs(it, model), packed)
    merged = written(paired.groupBy("shard").applyInArrow(_write_pairs(model), made), "lm-pairs")
    of = merged.filter("kind = 'pairs'").agg(*[F.sum(c).alias(c) for c in ("n", "n1", "n2", "n3", "n4")]).first()
    model.paired = frozenset(merged.filter("kind = 'pairs'").select("shard").toArrow()["shard"].to_pylist())
    model.pairs, model.high = of["n"], discounts(of["n1"], of["n2"], of["n3"], of["n4"])

    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    told = every.join(merged.filter("kind != 'pairs'").select("shard", "kind", "ids", "values"), "shard", "left")
    stats = told.groupBy("shard").applyInArrow(_write_stats(model), made).agg(F.max("total").alias("start"), *[F.sum(c).alias(c) for c in ("n", "n1", "n2", "n3", "n4")]).first()
    model.low = discounts(stats["n1"], stats["n2"], stats["n3"], stats["n4"])
    model.spare = (model.low[0] * stats["n1"] + model.low[1] * stats["n2"] + model.low[2] * stats["n"]) / model.pairs
    model.start_spare = stats["start"] / 1e6 / model.texts
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model, text_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    words, known = Words(model), WordHashes()
    n, v = model.tokens, model.words
    high, low = (np.array([0.0, *d]) for d in (model.high, model.low))
    def pair_counts(keys: np.ndarray) -> np.ndarray:
        """Counts of the ascending distinct ``keys``."""
        shard = (mixed(keys) % np.uint64(model.shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(model.shards + 1))
        out = np.zeros(len(keys), np.int64)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if s not in model.paired:
                continue
            i, j = cuts[s], cuts[s + 1]
            own, small = words.array("pair", s, np.uint64), words.array("pairs", s, np.uint8)
            want = keys[by[i:j]]
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            count = np.where(own[at] == want, small[at], 0).astype(np.int64)
            if (full := np.flatnonzero(count == 255)).size:
                big, bigs = words.array("bigpair", s, np.uint64), words.array("bigpairs", s, np.uint64)
                count[full] = bigs[np.searchsorted(big, want[full])]
            out[by[i:j]] = count
        return out

    for batch in slices(batches, text_col, CHUNK_BYTES):
        tokens, lengths = hashed_texts(batch.column(text_col), known)
        ids, place, word, before = _pair_ids(words, tokens, lengths)
        in_model = ids >= 0
        count, follow, spare = np.zeros(len(ids)), np.zeros(len(ids)), np.ones(len(ids))
        count[in_model] = words.take("count", ids[in_model], np.uint64)
        if n:
            follow[in_model] = words.take("follow", ids[in_model], np.uint64)
            spare[in_model] = words.take("spare", ids[in_model], np.float32)
        even = model.spare / (v + 1)
        lower = np.maximum(follow - low[np.minimum(follow, 3).astype(int)], 0) / max(model.pairs, 1) + even
        p = lower[place]
        # the place of what each token follows is that of the token before it
        previous = np.append(0, place[:-1])
        total, share = count[previous], spare[previous]
        begin = lengths.cumsum() - lengths
        total[begin], share[begin] = model.texts, model.start_spare
        follows_known = (before >= 0) & (total > 0)
        both = follows_known & (word >= 0)
        keys, at = np.unique(before[both].astype(np.uint64) * np.uint64(v + 1) + word[both].astype(np.uint64), return_inverse=True)
        seen = np.zeros(len(p))
        seen[both] = pair_counts(keys)[at]
        seen = np.maximum(seen - high[np.minimum(seen, 3).astype(int)], 0)
        p = np.where(follows_known, seen / np.maximum(total, 1) + share * p, p)
        base = np.log10((count[place] + 0.1) / (n + 0.1 * (v + 1)))
        add = lambda x, at=begin: np.add.reduceat(x, at)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.select(keep).columns,
                pa.array(lengths, pa.int64()),
                pa.array(add((count[place] > 0).astype(np.int64)), pa.int64()),
                pa.array(np.full(len(batch), n), pa.int64()),
                pa.array(add(base), pa.float64()),
                pa.array(add(np.log10(p)), pa.float64()),
            ],
            names=[*keep, *SCORES],
        )


SCORES = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score and score (both log10) of each whole text.

    Tokens are the text's words and one end.  A null or empty text is scored
    as its end alone.  An unknown word has the even share of the words' mass,
    and as a context says nothing of the next word.  Columns of ``docs`` with
    the new names must not be among ``keep``.
    """
    keep = docs.columns if keep is None else keep
    if clash := set(SCORES) & {c.lower() for c in keep}:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    new = [T.StructField(c, T.DoubleType() if c.endswith("score") else T.LongType()) for c in SCORES]
    schema = T.StructType([docs.schema[c] for c in keep] + new)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number for each shard, of 32 million characters
    return docs.select(*{f"`{c}`": 0 for c in [*keep, text_col]}).mapInArrow(lambda it: _score(it, shared.value, text_col, keep), schema)
