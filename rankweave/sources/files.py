"""Readers and writers of the formats that the operators' inputs come in."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import distinct_in_order, from_file_name, mid_of_row_name, stripped
from ..functions.texts import without_tags
from .shared import spread


def relative(base: str) -> Column:
    """The current row's file path below ``base``."""
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^\w+:/+", "/")
    root = "/" + base.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.substring(path, F.lit(len(root) + 1), F.length(path))).otherwise(path)


def row_name_column(columns: Sequence[str]) -> str:
    """Row.names, else the second column if the first has no name (Spark reads it as _c0), else the first."""
    if "Row.names" in columns:
        return "Row.names"
    return columns[1] if columns[0] in ("", "_c0") and len(columns) > 1 else columns[0]


def coordinates(spark: SparkSession, path: str, name_part: str | None = None, strict: bool = False, value: str = "Pseudotime", pattern: str | None = None, base: str = "/") -> DataFrame:
    """(src, mid, value, file) of coordinate CSV files under ``path``.

    Of files whose largest value isn't positive, or whose name holds no
    source, none is returned; ``strict`` makes either an error, as a missing
    column is in both ways.  ``name_part`` reads only files whose path holds it.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    raw = reader.option("pathGlobFilter", pattern).csv(path) if pattern else reader.csv(path)
    if value not in raw.columns:
        raise ValueError(f"no column {value}")
    name = row_name_column([c for c in raw.columns])
    rows = raw.select(F.col(f"`{name}`").alias("row"), F.col(value).try_cast("double").alias("value"), F.col("_metadata.file_path").alias("path"), relative(base).alias("file"))
    if name_part:
        rows = rows.filter(F.contains("path", F.lit(name_part)))
    most = rows.groupBy("path").agg(F.max("value").alias("most"))
    source = F.coalesce(from_file_name(F.col("path")), from_file_name(F.element_at(F.split("path", "/"), -2)))
    files = most.withColumn("src", source)
    good = F.col("src").isNotNull() & (F.col("most") > 0)
    if strict:
        bad = files.filter(~F.coalesce(good, F.lit(False))).limit(1).collect()
        if bad:
            raise ValueError(f"no source or no positive {value}: {bad[0]['path']}")
    rows = rows.join(files.filter(good).select("path", "src"), "path").filter(F.col("value").isNotNull())
    return rows.select("src", mid_of_row_name(F.col("row"), F.col("src")).alias("mid"), "value", "file")


def matrix(spark: SparkSession, path: str, feature: str = "feature", sample: str = "sample") -> DataFrame:
    """(feature, sample, value) of a tab-separated matrix whose first column holds the row names."""
    wide = spark.read.option("header", True).option("sep", "\t").csv(path)
    first, *samples = wide.columns
    return wide.unpivot([F.col(f"`{first}`").alias(feature)] if first != feature else [feature], [F.col(f"`{c}`") for c in samples], sample, "value").withColumn("value", F.col("value").try_cast("double"))


def taxonomy(spark: SparkSession, path: str, names: Sequence[str] = ("feature", "species")) -> DataFrame:
    """A tab-separated table with a header, its columns renamed; quotes are plain characters."""
    return spark.read.schema(", ".join(f"{n} string" for n in names)).option("header", True).option("enforceSchema", True).option("sep", "\t").option("quote", "").csv(path)


def reference(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t", normal: bool = True) -> DataFrame:
    """The columns of a reference table, trimmed and in lower case unless it is to be read as it stands; null as empty."""
    df = spark.read.option("header", True).option("sep", sep).csv(path).select(*[F.col(f"`{c}`") for c in columns])
    clean = lambda c: F.coalesce(F.lower(F.trim(F.col(f"`{c}`"))) if normal else F.col(f"`{c}`"), F.lit(""))
    return df.select(*[clean(c).alias(c) for c in columns])


def gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, type) and edges (source, target, relation) of a graph in GML; a node without label has its id as one.

    The file is cut at the beginning of each block, so it is read as records.
    """
    blocks = spark.read.option("lineSep", "]").text(path)
    field = lambda name: F.coalesce(F.nullif(F.regexp_extract("value", rf'(?s)\b{name} +"([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("value", rf"(?s)\b{name} +([^\s\"\]]+)", 1), F.lit("")))
    nodes = blocks.filter(F.col("value").rlike(r"(?s)\bnode\s*\[")).select(field("id").alias("number"), field("label").alias("label"), field("type").alias("type"))
    nodes = nodes.select("number", F.coalesce("label", "number").alias("id"), F.coalesce("label", "number").alias("label"), F.coalesce("type", F.lit("unknown")).alias("type"))
    edges = blocks.filter(F.col("value").rlike(r"(?s)\bedge\s*\[")).select(field("source").alias("s"), field("target").alias("t"), field("relation").alias("relation"))
    end = lambda a, b: nodes.select(F.col("number").alias(a), F.col("id").alias(b))
    edges = edges.join(end("s", "source"), "s", "left").join(end("t", "target"), "t", "left")
    return nodes.select("id", "label", "type"), edges.select(F.coalesce("source", "s").alias("source"), F.coalesce("target", "t").alias("target"), "relation")


def write_gml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as GML blocks, one per line, ids as labels' numbers are; a missing label is the id."""
    q = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c, F.lit("")), r'["\]]', "'"), F.lit('"'))
    n = nodes.select(F.concat(F.lit("node [ id "), q(F.col("id")), F.lit(" label "), q(F.coalesce(F.nullif("label", F.lit("")), "id")), F.lit(" type "), q(F.col("type")), F.lit(" ]")).alias("value"))
    e = edges.select(F.concat(F.lit("edge [ source "), q(F.col("source")), F.lit(" target "), q(F.col("target")), F.lit(" relation "), q(F.col("relation")), F.lit(" ]")).alias("value"))
    n.unionByName(e).write.mode("overwrite").text(path)


def write_stage(df: DataFrame, path: str, partition: Sequence[str] = ("run_id",)) -> None:
    """A stage's table; a run that is written again replaces its own partitions only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


PASSAGES = "documents array<struct<passages: array<struct<infons: map<string,string>, text: string>>>>"


def passages(df: DataFrame, key: str, document: str) -> DataFrame:
    """(key, pos, section, text): the passages of full-text documents in JSON."""
    doc = df.select(key, F.from_json(document, PASSAGES).alias("d"))
    each = doc.select(key, F.posexplode(F.flatten(F.transform("d.documents", lambda x: x["passages"]))).alias("pos", "p"))
    section = F.concat_ws("|", F.try_element_at("p.infons", F.lit("section_type")), F.try_element_at("p.infons", F.lit("type")), F.try_element_at("p.infons", F.lit("title")))
    return each.select(key, "pos", section.alias("section"), F.coalesce("p.text", F.lit("")).alias("text")).filter(stripped(F.col("text")) != "")


#: The fields of a protocol's step whose values are its text, at whatever depth.
TEXT_KEYS = {"title", "name", "description", "text", "content", "value", "step", "amount", "duration", "temperature"}


def _step_texts(value) -> Iterator[str]:
    """The values of text fields in a parsed JSON value, outer ones before those within."""
    if isinstance(value, list):
        for v in value:
            yield from _step_texts(v)
    elif isinstance(value, dict):
        for k, v in value.items():
            if k.lower() in TEXT_KEYS and isinstance(v, (str, int, float)):
                yield str(v)
            yield from _step_texts(v)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def step_texts(documents: pd.Series) -> pd.Series:
    """For each protocol in JSON and each of its steps the texts that it holds, nested ones too."""

    def steps(document: str | None) -> list[list[str]]:
        try:
            found = json.loads(document or "null")
        except ValueError:
            return []
        some = found.get("steps") if isinstance(found, dict) else None
        return [list(_step_texts(x)) for x in some] if isinstance(some, list) else []

    return documents.map(steps)


PROTOCOL = "id string, title string, description string, doi string, peer_reviewed boolean, materials array<struct<name: string, vendor: struct<name: string>, sku: string, url: string>>"


def protocols(df: DataFrame, document: str, most: int = 20) -> DataFrame:
    """Protocol records in JSON: id, title, description, doi, peer_reviewed, and steps and materials as lists of ``most`` at most.

    A step's text is that of its text fields at any depth, without repeats; a
    step without any has no entry, and keeps its number.  A material is its
    name, vendor, SKU and URL.  The records are dealt evenly over tasks first:
    a small file, well packed, would be the work of a few.
    """
    df = spread(df)
    p = df.select(F.from_json(document, PROTOCOL).alias("p"), step_texts(F.col(document)).alias("s")).select("p.*", "s")
    clean = lambda c: F.transform(c, lambda x: without_tags(x))
    step = F.transform("s", lambda s: without_tags(F.array_join(distinct_in_order(clean(s)), " | "), 900))
    numbered = F.transform(step, lambda s, i: F.when(s != "", F.concat(F.lit("Step "), i + 1, F.lit(": "), s)))
    full = lambda c: F.nullif(c, F.lit(""))
    material = F.transform("materials", lambda m: without_tags(F.concat_ws(" | ", full(m["name"]), F.concat(F.lit("vendor: "), full(m["vendor"]["name"])), F.concat(F.lit("SKU: "), full(m["sku"])), full(m["url"])), 500))
    return p.withColumns({"materials": F.slice(distinct_in_order(material), 1, most), "steps": F.slice(F.array_compact(numbered), 1, most)}).drop("s")
