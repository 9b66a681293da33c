"""The whole ranking over words: sources and intermediates are words of benchmark items, documents are the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import ranking
from ..sources.shared import kept
from .grading import folder
from .literature import CAND, EXP, EXP_SQL, candidates
from .registry import Tables, query

TARGET = "the"


def ranked(t: Tables) -> dict[str, DataFrame]:
    """Pairs of an item's first two words at the item's length; the third word lies between them in the graph."""
    words = kept(candidates(t), "words")
    lengths = t.benchmark.select(F.col("item_id").alias("cand"), F.char_length("text").cast("double").alias("length"))
    coordinates = words.join(lengths, "cand").groupBy("src", "mid").agg(F.max("length").alias("value"))
    via = lambda a, b, r: words.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(r).alias("relation"))
    edges = via("src", "dst", "begins").unionByName(via("dst", "mid", "ends")).filter("source != target").distinct()
    nodes = words.select(F.explode(F.array("src", "mid", "dst")).alias("id")).distinct().select("id", F.col("id").alias("label"), F.lit("word").alias("type"))
    known = ranking.Reference("source_mid", words.select("mid", "src").filter("src < mid"), "src", "mid")
    return ranking.run(coordinates, nodes, edges, t.documents, TARGET, EXP, folder(t, "ranking"), {"known": known})


WHOLE = rf"""{CAND}, cm AS MATERIALIZED (SELECT DISTINCT src, mid FROM ca WHERE src < mid), co AS (SELECT src, mid, max(length(text))::DOUBLE AS value FROM ca JOIN benchmark ON cand = item_id GROUP BY ALL),
nr AS (SELECT *, least(value, max(value) OVER (PARTITION BY src) - value) AS near, count(*) OVER (PARTITION BY src) AS n FROM co),
rk AS (SELECT src, mid, round(1 - (row_number() OVER (PARTITION BY src ORDER BY near, mid) - 1) / n, 4) AS signal FROM nr),
sg AS MATERIALIZED (SELECT * FROM rk ORDER BY signal DESC, src, mid LIMIT 200),
ed AS (SELECT src AS a, dst AS b, 'begins' AS r FROM ca UNION SELECT dst, mid, 'ends' FROM ca),
pa AS (SELECT src, mid, 1 AS length, src || ' -[' || r || ']-> ' || mid AS path FROM sg JOIN ed ON a = src AND b = mid
  UNION SELECT src, mid, 2, src || ' -[' || e.r || ']-> ' || e.b || ' -[' || f.r || ']-> ' || mid FROM sg JOIN ed e ON e.a = src JOIN ed f ON f.a = e.b AND f.b = mid WHERE e.b NOT IN (src, mid)
  UNION SELECT src, mid, 3, src || ' -[' || e.r || ']-> ' || e.b || ' -[' || f.r || ']-> ' || f.b || ' -[' || g.r || ']-> ' || mid FROM sg JOIN ed e ON e.a = src JOIN ed f ON f.a = e.b JOIN ed g ON g.a = f.b AND g.b = mid WHERE e.b NOT IN (src, mid) AND f.b NOT IN (src, mid, e.b)),
bp AS (SELECT src, mid, arg_min(path, (length, path)) AS path, count(*) AS n_paths FROM pa GROUP BY ALL),
tm AS (SELECT unnest([src, mid, '{TARGET}']) AS term FROM sg),
lo AS MATERIALIZED (SELECT doc_id, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS ws, {EXP_SQL} AS exp FROM documents),
td AS MATERIALIZED (SELECT term, doc_id, exp FROM lo JOIN (SELECT DISTINCT term FROM tm) ON CASE WHEN length(term) <= 3 THEN list_contains(ws, term) ELSE contains(low, term) END),
ct AS (SELECT sg.src, sg.mid, count(*) FILTER (WHERE s) AS pair_sm, count(*) FILTER (WHERE d) AS pair_md, count(*) FILTER (WHERE s AND exp) AS pair_sm_exp, count(*) FILTER (WHERE d AND exp) AS pair_md_exp, count(*) FILTER (WHERE s AND d AND exp) AS chain_count
  FROM sg LEFT JOIN (SELECT m.term, m.doc_id, m.exp, g.src, x.doc_id IS NOT NULL AS s, y.doc_id IS NOT NULL AS d FROM sg g JOIN td m ON m.term = g.mid LEFT JOIN td x ON x.doc_id = m.doc_id AND x.term = g.src LEFT JOIN td y ON y.doc_id = m.doc_id AND y.term = '{TARGET}') h ON h.term = sg.mid AND h.src = sg.src GROUP BY ALL),
al AS MATERIALIZED (SELECT *, CASE WHEN max(chain_count) OVER () <= 0 THEN 1 ELSE 1 - ln(1 + chain_count) / ln(1 + max(chain_count) OVER ()) END AS novelty FROM sg JOIN ct USING (src, mid)),
ev AS (SELECT src, mid, least(pair_sm, pair_md) + 10 * EXISTS (SELECT 1 FROM cm k WHERE (contains(k.src, al.src) OR contains(al.src, k.src)) AND (contains(k.mid, al.mid) OR contains(al.mid, k.mid)))::INT AS evidence_count FROM al)"""


@query("RUN_whole_ranking", f"""WITH {WHOLE} SELECT src, mid, signal, path, coalesce(n_paths, 0) AS n_paths, chain_count, round(novelty, 6) AS novelty,
    CASE WHEN signal > (SELECT median(signal) FROM al) THEN CASE WHEN novelty >= (SELECT median(novelty) FROM al) THEN 'I' ELSE 'III' END WHEN novelty >= (SELECT median(novelty) FROM al) THEN 'II' ELSE 'IV' END AS quadrant,
    round(signal * (1 + log2(1 + pair_sm_exp)) * (1 + log2(1 + pair_md_exp)), 4) AS composite_score, evidence_count FROM al LEFT JOIN bp USING (src, mid) JOIN ev USING (src, mid)""")
def whole(t):
    tables = ranked(t)
    ev = tables["evidence"].select("cand", F.col("chain_count").alias("evidence_count"))
    return tables["quadrants"].join(ev, "cand").select("src", "mid", "signal", "path", "n_paths", "chain_count", F.round("novelty", 6).alias("novelty"), "quadrant", "composite_score", "evidence_count")
