"""References in nested documents and in running text: which there are, and documents without those that aren't allowed.

A document is walked twice, in the same order.  The first walk numbers its
references; these are joined with what is allowed, a table of any size; the
second walk leaves out the numbers that weren't met.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordered import joined

#: How a text names an article, and the fields that list articles' ids.
NAMED = re.compile(r"\bPMID\s*:?\s*([0-9]+)\b", re.IGNORECASE)
LISTS = {"pmids", "representative_pmids"}


def walked(value, stays: Callable[[str], bool]):
    """``value`` without the references for which ``stays`` is false; it is asked once for each, in order."""
    if isinstance(value, dict):
        return {k: [i for i in _ids(v) if stays(i)] if k in LISTS and isinstance(v, list) else walked(v, stays) for k, v in value.items()}
    if isinstance(value, list):
        return [walked(v, stays) for v in value]
    if isinstance(value, str):
        kept = NAMED.sub(lambda m: m[0] if stays(m[1]) else "", value)
        return re.sub(r"\s+", " ", re.sub(r"\[\s*\]", "", kept)).strip(" ;,|")
    return value


def _ids(values: list) -> list[str]:
    return [s for s in (str(v).strip() for v in values if v is not None) if s]


def _parsed(text: str):
    """A JSON object or array, or else the text itself."""
    if text.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(text)
        except ValueError:
            pass
    return text


def _written(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def references(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, id): the references of each document, numbered from 0 in the order in which they stand."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, ids = [], [], []
            for i, value in enumerate(batch.column(text)):
                own: list[str] = []
                if value.is_valid:
                    walked(_parsed(value.as_py()), lambda x: own.append(x) is None)
                row += [i] * len(own)
                at += range(len(own))
                ids += own
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(ids, pa.string())], names=[key, "at", "id"])

    rows = docs.select(key, text)
    return rows.mapInArrow(work, T.StructType([rows.schema[key], T.StructField("at", T.IntegerType()), T.StructField("id", T.StringType())]))


def only_allowed(docs: DataFrame, allowed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cleaned: JSON, at any depth, or running text without references to articles that aren't allowed.

    ``allowed`` has the column id, and ``key`` too where each document has
    its own.  Lists of ids lose those that aren't allowed; texts lose the
    mention, empty brackets, repeated white space and separators at their ends.
    Texts without references are cleaned up alike.  Null stays null.  Keys must
    not repeat.
    """
    columns = docs.columns
    met, ids = references(docs, key, text), allowed.select(*([key] if key in allowed.columns else []), F.col("id").cast("string").alias("id")).distinct()
    stay = joined(met, ids, [key, "id"]) if key in ids.columns else met.join(ids, "id")
    stay = stay.groupBy(key).agg(F.collect_list("at").alias("_stay"))  # of one document
    here = docs.withColumnRenamed(key, "_key").join(stay.withColumnRenamed(key, "_of"), F.col("_key").eqNullSafe(F.col("_of")), "left").drop("_of").withColumnRenamed("_key", key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for value, stays in zip(batch.column(text), batch.column("_stay")):
                numbers, at = set(stays.as_py() or []), iter(range(1 << 62))
                new.append(_written(walked(_parsed(value.as_py()), lambda _: next(at) in numbers)) if value.is_valid else None)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(c) for c in columns], names=columns)

    return here.select(*columns, "_stay").mapInArrow(work, docs.schema)
