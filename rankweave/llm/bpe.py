"""BPE encoding and decoding over a pair occurrence index.

Each task cuts its texts into pieces, keeps each distinct piece once, and lays
the pieces' symbols out in one array with links to the next and previous
symbol.  An index maps every mergeable pair to all its positions.  The active
ranks are applied in ascending order, each to all its positions at once; only
the lists of the pairs that a merge touches are updated.  A merge's result
always has a higher rank than the merge itself, so one ascending sweep gives
each piece what merging it alone would give.

The vocabulary file is read on the driver and broadcast (its size is fixed).
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import cuts, slices

#: Distinct words that a task remembers before it starts afresh.
MOST_WORDS = 250_000
#: Bytes of text, and tokens, that a task works on at a time, about.
SLICE_BYTES = 6_000_000
SLICE_TOKENS = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with word ends, from the JSON text of a tokenizer file."""

    def __init__(self, text: str):
        data = json.loads(text)
        model, steps = data["model"], data["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in data["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"]:
            raise ValueError("this kind of tokenizer file isn't handled")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.words = regex.compile(steps[0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        if not all("<|" in x for x in self.special):
            raise ValueError("special tokens of another form aren't handled")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.inner = np.array([ids[c] for c in symbols], np.int32)
        self.last = np.array([ids[c + end] for c in symbols], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int32)
        self.right = np.array([ids[b] for _, b in merges], np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        born = np.full(max(self.tokens) + 1, -1)
        born[self.made[::-1]] = np.arange(len(merges))[::-1]
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge comes before one that it builds on; one ascending sweep would not do")
        keys = self.left.astype(np.int64) << 32 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none; negative symbols have none."""
        want = a.astype(np.int64) << 32 | b.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.order[at], -1)

    def normal(self, text: str) -> str:
        """Composed and lower-cased; runs of white space needn't shrink to one space, since no piece holds any."""
        if text.isascii():
            return text.lower()
        # lower() alone would turn a capital sigma that ends a word into another letter
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in order; a special token's own string is a piece by itself."""
        if "<|" not in text:
            return self.words.findall(self.normal(text))
        parts = self.specials.split(text)
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.words.findall(self.normal(part)))]

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' token ids in a row, and how many each piece has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))  # no piece is empty
        ends = size.cumsum()
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        symbol = np.append(self.inner[raw], np.int32(-1))  # the last one stands for both ends of every piece
        symbol[ends - 1] = self.last[raw[ends - 1]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends - size] = n

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray) -> None:
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, places in zip(rank[np.append(0, cut)].tolist(), np.split(at, cut)):
                if r in index:
                    index[r].append(places)
                else:
                    index[r] = [places]
                    heapq.heappush(active, r)

        every = np.flatnonzero(after[:n] < n)
        add(every, self.ranks(symbol[every], symbol[after[every]]))
        while active:
            r = heapq.heappop(active)
            at = index.pop(r)
            at = at[0] if len(at) == 1 else np.concatenate(at)
            at = np.unique(at)
            a, b = self.left[r], self.right[r]
            right = after[at]
            still = (symbol[at] == a) & (symbol[right] == b)
            at, right = at[still], right[still]
            if a == b and len(at) > 1:  # of overlapping pairs the left one merges
                begin = np.append(True, right[:-1] != at[1:])
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
                at, right = at[run % 2 == 0], right[run % 2 == 0]
            if not len(at):
                continue
            symbol[at], symbol[right] = self.made[r], -2
            far = after[right]
            after[at] = far
            before[far] = at
            near = before[at]
            add(np.concatenate([near, at]), np.concatenate([self.ranks(symbol[near], symbol[at]), self.ranks(symbol[at], symbol[far])]))
        alive = symbol[:n] >= 0
        return symbol[:n][alive], np.add.reduceat(alive, ends - size, dtype=np.int64) if n else size


class _Known(dict):
    """Key -> its number; unknown keys are numbered and noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = k = len(self)
        self.new.append(key)
        return k


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start`` and are ``size`` long, one after another."""
    ends = size.cumsum()
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class _Words:
    """The token ids of all distinct words that a task has met; a word is what lies between two spaces or line ends.

    No piece spans a space, and normalising never reaches over one, so a
    word's ids don't depend on its neighbours.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words, self.pieces = _Known(), _Known()
        for s in vocabulary.special:
            self.pieces[s]
        self.pieces.new.clear()
        self.piece_ids, self.piece_size = np.array(list(vocabulary.special.values()), np.int32), np.ones(len(vocabulary.special), np.int64)
        self.ids, self.size = np.empty(0, np.int32), np.empty(0, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, text.replace("\n", " ").split(" ")), np.int64)

    def learn(self) -> None:
        """Encode the words met since the last call."""
        new, get = self.words.new, self.pieces.__getitem__
        parts = [[get(p) for p in self.vocabulary.pieces(w)] for w in new]
        if self.pieces.new:
            ids, size = self.vocabulary.merged([p.encode() for p in self.pieces.new])
            self.piece_ids, self.piece_size = np.concatenate([self.piece_ids, ids]), np.concatenate([self.piece_size, size])
        count = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter((x for p in parts for x in p), np.int64, count.sum())
        size = self.piece_size[flat]
        start = self.piece_size.cumsum() - self.piece_size
        total = np.append(0, size.cumsum())
        ends = count.cumsum()
        self.ids = np.concatenate([self.ids, _gather(self.piece_ids, start[flat], size)])
        self.size = np.concatenate([self.size, total[ends] - total[ends - count]])
        new.clear()
        self.pieces.new.clear()


def _encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, text_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    known = None
    for batch in slices(batches, text_col, SLICE_BYTES):
        if known is None or len(known.words) > MOST_WORDS:
            known = _Words(vocabulary)
        numbers = [known.numbers(t.as_py() or "") for t in batch.column(text_col)]
        known.learn()
        start = known.size.cumsum() - known.size
        each = np.array([known.size[x].sum() for x in numbers], np.int64)
        for i, j in cuts(each, SLICE_TOKENS):
            x = np.concatenate(numbers[i:j])
            ids = _gather(known.ids, start[x], known.size[x])
            offsets = np.append(0, each[i:j].cumsum()).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.select(keep).slice(i, j - i).columns, ids], names=[*keep, "ids"])


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The vocabulary of a broadcast file, built once per worker process."""
    text = shared.value
    if (k := hash(text)) not in _loaded:
        _loaded.clear()
        _loaded[k] = Vocabulary(text)
    return _loaded[k]


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a column ids (array<int>): each whole text's token ids, without added special tokens.

    The ids are those of the tokenizers library for the same file.  A null
    text counts as empty and has no ids.  keep: the columns to return, all by
    default; a column of ``docs`` named ids must not be among them.
    """
    keep = docs.columns if keep is None else keep
    if "ids" in keep:
        raise ValueError("rename the column ids first")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    shared = docs.sparkSession.sparkContext.broadcast(_read(path))
    return docs.select(*{f"`{c}`": 0 for c in [*keep, text_col]}).mapInArrow(lambda it: _encode_batches(it, _vocabulary(shared), text_col, keep), schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ids replaced by decoded (string): the tokens with one space between, as the file names no decoder.

    Null ids give null, no ids the empty string; an id outside the vocabulary
    is left out, as the library does.
    """
    keep = [c for c in coded.columns if c != ids_col]
    schema = T.StructType([coded.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])
    shared = coded.sparkSession.sparkContext.broadcast(_read(path))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _vocabulary(shared).tokens
        for batch in slices(batches, ids_col, SLICE_TOKENS):
            ids = batch.column(ids_col)
            out = [None if not x.is_valid else " ".join([tokens[i] for i in x.values.to_numpy(zero_copy_only=False).tolist() if i in tokens]) for x in ids]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, "decoded"])

    return coded.mapInArrow(texts, schema)
