"""One query per operator over the driver's tables, and the SQL that gives the same rows where SQL can.

``queries()`` and ``oracle_sql()`` are merged into those of ``__spark_entry__``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, lm_score, pii, warc
from .bitplane import clustered
from .common import LOWER, UPPER, new_path, table
from .exact_dedup import duplicate_groups
from .fingerprint import fingerprinted
from .mixing import taken_copies
from .near_dup import near_duplicates
from .quality import classified
from .sharding import placed
from .whitening import whitened


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(docs.filter("NOT held_out"))
    return langid.predict(docs, model, keep=["doc_id", "held_out"])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: For tests and the driver's tables; whoever pseudonymises real data brings a secret key.
DEMO_KEY = b"rankweave demonstration key"


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"), new_path(spark, "warc-all"), new_path(spark, "warc-deduplicated"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path(), keep=["doc_id"])
    coded = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids")
    return bpe.decode(coded, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenth = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tenth.alias("held_out"))
    model = lm_score.train(docs.filter("NOT held_out"))
    return lm_score.score(docs, model, keep=["doc_id", "held_out"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"), 8)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_language_id, op3_near_duplicates, op4_pii_pseudonyms, op5_warc_revisits, op6_exact_dedup, op7_bpe, op8_lm_score, op9_mixing, op10_fingerprints, op11_clusters, op12_shards, op13_whitening)}


OP6_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 2))::INT AS slot
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
  FROM d GROUP BY source),
-- round by round: sources above twice their size stop there, the rest share what is left
fill AS (
  SELECT 0 AS round, source, source_size, weight, false AS stopped, 0.0::DOUBLE AS target FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, stopped OR want > 2 * source_size,
         CASE WHEN stopped OR want > 2 * source_size THEN 2 * source_size ELSE want END
  FROM (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) FILTER (WHERE stopped) OVER (), 0))
                  * weight / nullif(sum(weight) FILTER (WHERE NOT stopped) OVER (), 0) AS want FROM fill) f
  WHERE round < (SELECT count(*) FROM s)),
t AS (SELECT source, source_size, target FROM fill WHERE round = (SELECT count(*) FROM s)),
o AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY length(size::VARCHAR), substr(size::VARCHAR, 1, 2)::INT, slot, size, doc_id) AS nth FROM d),
c AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
         ('0x' || substr(md5('7/' || coalesce(o.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off, nth
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       ((floor(nth * each + off) - floor((nth - 1) * each + off)) * size)::BIGINT AS taken
FROM c
"""


def _round_sql(i: int) -> str:
    """Each vector's nearest centroid in round ``i``, and the centroids after it."""
    return f"""
a{i} AS MATERIALIZED (SELECT r, vec_id, x, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
  SELECT r, vec_id, x, c, list_sum(list_transform(range(1, 65), lambda i: (x[i] - m[i]) * (x[i] - m[i])))::BIGINT AS d FROM v, c{i}) GROUP BY ALL),
s{i} AS (SELECT cluster AS c, list(mean ORDER BY i) AS m FROM (
  SELECT cluster, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS mean FROM a{i}, range(1, 65) t(i) GROUP BY cluster, i) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(s{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN s{i} USING (c))"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY draw, x) - 1 AS c, x AS m FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS draw, x FROM v) ORDER BY draw, x LIMIT 16),
{",".join(_round_sql(i) for i in range(4))}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON cluster = c
"""

# the checksum byte by byte, by a table of 256 entries made from its polynomial; the jumps in 128-bit numbers
OP12_SQL = f"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS entry),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::UHUGEINT * 4294967296 + ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 9, 8))::UHUGEINT AS key FROM documents),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, length(h) // 2 + 1 AS size, key,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM h, t),
j AS (
  SELECT r, key, -1::BIGINT AS b, 0::BIGINT AS j FROM d
  UNION ALL
  SELECT r, k, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT r, j, key * 2862933555777941757 % 18446744073709551616::UHUGEINT + 1 AS k FROM j WHERE j < 8))
SELECT doc_id, size, text_crc32, 'key' AS law, b::INT AS shard, row_number() OVER (PARTITION BY b ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       CASE WHEN j = 8 THEN 8 ELSE b END::INT AS grown_shard
FROM d JOIN (SELECT r, max(b) AS b, max(j) AS j FROM j GROUP BY r) USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op9_mixing": OP9_SQL, "op11_clusters": OP11_SQL, "op12_shards": OP12_SQL}
