"""A corpus pipeline of five stages, each written out and read again by the next.

language ID -> exact dedup -> near-duplicate join -> mixing to target weights -> BPE.

All columns of ``documents`` go through all stages but the last, whatever their
names.  Null or blank texts and those without letters go in the first stage, as
no language accepts them.  A null id, language or source is a value like any
other; repeated rows are one document after the second stage.  Of ties the
largest id stays among equal texts, the least among near copies.  An empty
table gives an empty result.  Texts are worked on whole, one at a time at the
worst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.llm import bpe, exact_dedup, langid, mixing, near_dup
from rankweave.llm.common import written
from rankweave.llm.queries import tokenizer_path

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text no language accepts go."""
    learned = docs.filter(~langid.held_out(F.col("doc_id")))
    rows = docs.select(F.struct("*").alias("row"), "text")  # the columns travel in one, so that no name clashes
    return langid.predict(rows, langid.fit(learned), keep=["row"]).filter("NOT rejected").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return near_dup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids): the token ids of every document of the mix."""
    coded = bpe.encode(docs, tokenizer_path(), keep=["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language ID", language), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mix), ("BPE", tokens)]

#: SQL can express neither the language classifier nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{i}")
    return docs
