"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

from .test_near_dup import plain as plain_classes
from .test_small_operators import LOW, plain_targets

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    rows = [df.collect() for df in kept]
    ids = [[r["doc_id"] for r in x] for x in rows]
    for x in rows[1:5]:
        assert set(x[0].__fields__) == set(docs.columns)
    assert len(ids[1]) >= 0.98 * len(ids[0])

    groups = defaultdict(list)
    for r in rows[1]:
        groups[hashlib.sha256((r["text"] or "").translate(LOW).encode()).digest()].append(r["doc_id"])
    assert sorted(ids[2]) == sorted(max(g) for g in groups.values())

    classes = plain_classes([(r["doc_id"], r["text"]) for r in rows[2]])
    assert sorted(ids[3]) == sorted({c for c, _ in classes.values()})

    sizes, taken = Counter(), Counter()
    for r in rows[3]:
        sizes[r["source"]] += len(r["text"].split())
    for r in rows[4]:
        taken[r["source"]] += len(r["text"].split())
    want = plain_targets(dict(sizes))
    longest = max(len(r["text"].split()) for r in rows[3])
    assert all(abs(taken[s] - want[s]) <= longest for s in sizes)
    assert max(Counter(ids[4]).values()) <= 2

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in rows[4]}
    assert sorted(ids[5]) == sorted(ids[4])
    for r in rows[5]:
        assert r["ids"] == library.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "mixing", "BPE"]


def test_nulls_ties_extra_columns_and_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clash = ["score", "rejected", "lang_pred", "row", "_digest", "_nth", "_key", "copies", "ids", "slot", "_id"]
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, None, "en", None, 0), (-2, " \n", None, "s", 2), (-3, "1234 !!", "en", "s", 7), (None, "the and of the and with", None, None, 23), (-4, "the and of " * 9000, "en", None, 99000), (-4, "the and of " * 9000, "en", None, 99000)], docs.schema)
    docs = docs.unionByName(odd).select("*", *[F.concat(F.lit(f"{n}:"), F.xxhash64("text").cast("string")).alias(n) for n in clash])
    whole = {(r["doc_id"], r["text"]): tuple(r) for r in docs.collect()}
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    for df in kept[1:5]:
        rows = df.collect()
        assert df.columns == docs.columns and rows
        assert all(tuple(r) == whole[r["doc_id"], r["text"]] for r in rows)
    assert not {r["doc_id"] for r in kept[1].collect()} & {-1, -2, -3}
    assert sum(r["doc_id"] == -4 for r in kept[2].collect()) <= 1
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_one_query(n):
    from rankweave.llm import queries

    assert len([q for q in queries.queries() if q.startswith(f"op{n}_")]) == 1
