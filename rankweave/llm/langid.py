"""Language identification by nearest centroid.

A text is a vector of its character n-grams (one to three letters, words
bounded by a space), hashed into a fixed number of columns, weighted by TF-IDF
and scaled to length one.  Each language has several centroids, found by
spherical k-means over its training texts, so that one language may look
several ways.  A text gets the language of the centroid with the largest
cosine, and is rejected if it is farther from it than the language's radius.

The classifier is fitted on a bounded sample of labelled rows (``per_language``
rows of each of at most ``most_languages`` languages, texts of at most
``most_chars``), so the model that is broadcast has a fixed size.  Predictions
read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Code points that are scored together, about.
CHUNK_CHARS = 1_000_000
CHUNK_DOCS = 128


@dataclass
class Model:
    columns: int
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    #: The language of each centroid, as an index into ``languages``.
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    languages: list[str] = field(default_factory=list)
    #: The least cosine that each language accepts.
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(texts: list[str], columns: int) -> np.ndarray:
    """Counts of hashed n-grams, a row per text; all other than letters is one space."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(p) for p in points])
    c = np.concatenate(points) if points else np.zeros(0, np.uint32)
    c = np.where(_letters()[c], c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])
    c, row = c[keep], row[keep]
    bits = np.uint32(32 - (columns.bit_length() - 1))
    out = np.zeros(len(texts) * columns, np.int64)
    # fixed odd multipliers that mix the code points and the length
    h = np.zeros(len(c), np.uint32)
    for n in (1, 2, 3):
        h = (h[: len(c) - n + 1] if n > 1 else h) * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
        one = row[: len(h)] == row[n - 1 :]
        if n == 1:
            one &= c != 32
        slot = (h * np.uint32(0x9E3779B1)) >> bits
        out += np.bincount((row[: len(h)] * columns + slot)[one], minlength=len(out))
    return out.reshape(len(texts), columns)


def _vectors(texts: list[str], columns: int, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(ngram_counts(texts, columns).astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= CHUNK_CHARS or len(part) == CHUNK_DOCS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of spherical k-means; each start is the vector farthest from those before."""
    chosen = [int(np.argmax(vectors @ vectors.mean(0)))]
    near = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[own == i].sum(0) if (own == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, most_languages: int = 200, most_chars: int = 20_000, columns: int = 8192, clusters: int = 4, slack: float = 0.4) -> Model:
    """A model of the languages of ``labelled``; rows without language or without a letter don't count.

    The sample is drawn by a hash of id and text, so reruns agree.  A fifth of
    a language's sample is set apart from clustering, one text at least if
    there are two: its radius lets through ``slack`` times the cosine that 95 %
    of these exceed.  Languages beyond the ``most_languages`` with the most
    rows, and those whose texts are all longer than ``most_chars``, are not
    learned, so never predicted.  Without any usable row the model has no
    language.
    """
    texts = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    usable = texts.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.char_length("text") <= most_chars))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return Model(columns)
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    part = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    rows = usable.withColumn("draw", draw).filter(F.col("draw") < F.coalesce(F.try_element_at(part, F.col("lang")), F.lit(0.0)))
    sample = rows.orderBy("draw", "id", "text").limit(2 * per_language * len(counts)).select("lang", "text").toPandas()
    if not len(sample):
        return Model(columns)

    present = np.zeros(columns)
    tallies = [ngram_counts(c, columns).astype(np.float32) for c in _chunks(sample["text"].tolist())]
    for t in tallies:
        present += (t > 0).sum(0)
    idf = (np.log((1 + len(sample)) / (1 + present)) + 1).astype(np.float32)
    v = np.log1p(np.concatenate(tallies)) * idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    model = Model(columns, idf, languages=sorted(sample["lang"].unique()))
    centroids, owner, least = [], [], []
    for i, lang in enumerate(model.languages):
        own = v[(sample["lang"] == lang).to_numpy()]
        apart = np.arange(len(own)) % 5 == 1
        found = _cluster(own[~apart], clusters)
        centroids.append(found)
        owner += [i] * len(found)
        judges = own[apart] if apart.any() else own
        least.append(slack * np.quantile((judges @ found.T).max(1), 0.05))
    model.centroids, model.owner, model.least = np.concatenate(centroids).astype(np.float32), np.array(owner), np.array(least, np.float32)
    return model


def _predict(batches: Iterator[pa.RecordBatch], model: Model, text_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, scores, rejected = [], [], []
        column = batch.column(text_col)
        texts = [t.as_py() or "" for t in column]
        lettered = [bool(_any_letter(t)) for t in texts]
        for part in _chunks(texts) if model.languages else ():
            cosines = _vectors(part, model.columns, model.idf) @ model.centroids.T
            best = cosines.argmax(1)
            langs += [model.languages[i] for i in model.owner[best]]
            top = cosines[np.arange(len(part)), best].clip(0, 1)
            scores += top.astype(float).tolist()
            rejected += (top < model.least[model.owner[best]]).tolist()
        if not model.languages:
            lettered = [False] * len(texts)
            langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        langs = [x if ok else UNKNOWN for x, ok in zip(langs, lettered)]
        scores = [x if ok else 0.0 for x, ok in zip(scores, lettered)]
        rejected = [x or not ok for x, ok in zip(rejected, lettered)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            names=[*keep, "lang_pred", "score", "rejected"],
        )


def _any_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected.

    A null text or one without a letter is ``und`` with score 0, and rejected;
    so is every text if the model has no language.  Of equally near centroids
    the first language by code point wins.  Repeated rows get equal results, but
    for the last digits of a score; an empty table gives an empty result.  A
    text is worked on whole: a task needs about 60 bytes for each of its
    characters.  Columns of ``docs`` with the
    new names must not be among ``keep``.
    """
    keep = docs.columns if keep is None else keep
    if clash := {"lang_pred", "score", "rejected"} & {c.lower() for c in keep}:
        raise ValueError(f"rename the columns {sorted(clash)} first")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(*{f"`{c}`": 0 for c in [*keep, text_col]}).mapInArrow(lambda it: _predict(it, shared.value, text_col, keep), schema)


def held_out(id_col: Column) -> Column:
    """True where crc32 of the id as text leaves 1 on division by 3; such rows are never learned from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1
