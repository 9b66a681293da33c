"""What the two Kneser-Ney operators share: words, their hashes, discounts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Stands for the end of a text; no word holds white space, so none has this hash's bytes.
END = b"\n"
#: Seed of Spark's ``xxhash64``, so that hashes made here and there agree.
SEED = 42


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; drop it when it grows."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = word_hash(word)
        return h


def hashed_texts(column: pa.Array, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words, each text ended by END, and how many tokens each text has.

    A-Z are lower-cased; words are split at ASCII white space.  A null text is
    an empty one.
    """
    if len(known) > 300_000:
        known.clear()
    get, end = known.__getitem__, [END]
    parts = [np.fromiter(map(get, (t.as_py() or b"").lower().split() + end), np.uint64) for t in column.cast(pa.binary())]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from how many n-grams have count 1 to 4.

    Where a count is missing the plain values 0.5, 1 and 1.5 stand in.
    """
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return float(np.clip(d1, 0.01, 0.99)), float(np.clip(d2, 0.01, 1.99)), float(np.clip(d3, 0.01, 2.99))


def planes(values: np.ndarray) -> bytes:
    """Integers as planes of equal bytes, so that the zeros of small ones compress well in a shuffle."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as planes of their differences."""
    return planes(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return from_planes(data, np.uint64).cumsum(dtype=np.uint64)


def sum_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each array of values over them."""
    if not len(keys):
        return keys, *values
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], *(np.add.reduceat(v[by], first) for v in values)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit image of each key."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))
