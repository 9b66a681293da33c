"""Queries over documents as a corpus, reference tables of part names, embeddings, and runs of events as a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, texts
from ..operators import catalog, corpus, embed, quadrant, refmatch
from ..sources import commits
from ..sources.shared import kept, shared_path
from .registry import Tables, query

EXP = ["license", "password", "ing "]
EXP_SQL = "regexp_matches(lower(text), 'license|password|ing ')"


def candidates(t: Tables) -> DataFrame:
    """(cand, src, mid, dst): the first three distinct words of each benchmark item."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))
    rows = t.benchmark.select(F.col("item_id").alias("cand"), words.alias("w")).filter(F.size("w") >= 3)
    return rows.select("cand", *[F.element_at("w", i + 1).alias(c) for i, c in enumerate(("src", "mid", "dst"))])


def terms(t: Tables) -> DataFrame:
    return candidates(t).select(F.explode(F.array("src", "mid", "dst")).alias("term")).distinct()


def found(t: Tables) -> DataFrame:
    """(doc_id, term, exp): the candidates' terms as whole words of the documents."""
    docs = t.documents
    flags = docs.select("doc_id", corpus.experimental(F.col("text"), EXP).alias("exp"))
    return kept(corpus.word_incidence(docs, terms(t)).join(flags, "doc_id"), "incidence")


CAND = r"""wd AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS pos FROM benchmark),
fw AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) AS nth FROM wd GROUP BY item_id, w),
ca AS (SELECT item_id AS cand, max(w) FILTER (WHERE nth = 1) AS src, max(w) FILTER (WHERE nth = 2) AS mid, max(w) FILTER (WHERE nth = 3) AS dst FROM fw GROUP BY item_id HAVING count(*) >= 3),
te AS (SELECT DISTINCT unnest([src, mid, dst]) AS term FROM ca)"""
FOUND = rf"""{CAND}, dw AS (SELECT DISTINCT doc_id, {EXP_SQL} AS exp, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), fo AS (SELECT doc_id, term, exp FROM dw JOIN te USING (term))"""
COUNTS = f"""{FOUND}, me AS (SELECT cand, doc_id, bool_or(exp) AS exp, bool_or(term = src) AS s, bool_or(term = mid) AS m, bool_or(term = dst) AS d FROM ca JOIN fo ON term IN (src, mid, dst) GROUP BY ALL),
co AS (SELECT ca.cand, count(*) FILTER (WHERE s AND m) AS pair_sm, count(*) FILTER (WHERE s AND m AND d) AS triple_smd, count(*) FILTER (WHERE s AND d) AS pair_sd, count(*) FILTER (WHERE m AND d) AS pair_md, count(*) FILTER (WHERE s AND m AND exp) AS pair_sm_exp, count(*) FILTER (WHERE s AND m AND d AND exp) AS triple_smd_exp, count(*) FILTER (WHERE m AND d AND exp) AS pair_md_exp
  FROM ca LEFT JOIN me USING (cand) GROUP BY ca.cand)"""


@query("LT1_term_incidence", f"WITH {FOUND} SELECT doc_id, term FROM fo")
def lt1(t):
    return found(t).select("doc_id", "term")


@query("LT1_substring_incidence", f"WITH {CAND} SELECT doc_id, term FROM documents JOIN te ON CASE WHEN length(term) <= 3 THEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])' || term || '($|[^\\p{{L}}\\p{{N}}])') ELSE contains(lower(text), term) END")
def lt1_substring(t):
    return corpus.incidence(t.documents, terms(t))


@query("LT2_cooccurrence_counts", f"WITH {COUNTS} SELECT * FROM co")
def lt2(t):
    return corpus.counts(candidates(t), found(t))


@query("LT2_full_chain_counts", f"WITH {COUNTS} SELECT cand, triple_smd AS full_chain, triple_smd_exp AS full_chain_exp FROM co")
def lt2_chain(t):
    chains = candidates(t).select("cand", F.explode(F.array("src", "mid", "dst")).alias("term"))
    return corpus.chain_counts(chains, found(t))


@query("LT3_experimental_flag", f"SELECT doc_id, {EXP_SQL} AS exp FROM documents")
def lt3(t):
    return t.documents.select("doc_id", corpus.experimental(F.col("text"), EXP).alias("exp"))


@query("LT4_chain_count", f"WITH {COUNTS} SELECT cand, triple_smd_exp AS chain_count FROM co")
def lt4(t):
    return corpus.counts(candidates(t), found(t)).select("cand", F.col("triple_smd_exp").alias("chain_count"))


@query("LT5_best_chain", f"WITH {CAND} SELECT cand, length(src) > 4 AS has_path, CASE WHEN length(src) > 4 THEN src || ' -[a]-> ' || mid END AS path, CASE WHEN length(src) > 4 THEN 2 ELSE 0 END AS n_paths FROM ca")
def lt5(t):
    c = candidates(t).filter(F.length("src") > 4)
    one = c.select("cand", F.array("src", "mid").alias("nodes"), F.array(F.lit("a")).alias("relations"), F.lit(1).alias("length"))
    two = c.select("cand", F.array("src", "mid", "dst").alias("nodes"), F.array(F.lit("a"), F.lit("b")).alias("relations"), F.lit(2).alias("length"))
    return corpus.best_chains(candidates(t), one.unionByName(two)).select("cand", "has_path", "path", F.col("n_paths").cast("int").alias("n_paths"))


EDGE = f"""{FOUND}, st AS (SELECT cand, 0 AS pos, src AS a, mid AS b FROM ca UNION ALL SELECT cand, 1, mid, dst FROM ca),
ec AS (SELECT cand, pos, a, b, (SELECT count(*) FROM fo x JOIN fo y USING (doc_id) WHERE x.term = a AND y.term = b) AS n FROM st)"""


@query("AG15_edge_cooccurrence", f"WITH {EDGE} SELECT cand, pos, a, b, n FROM ec")
def ag15(t):
    return corpus.edge_counts(candidates(t).select("cand", F.array("src", "mid", "dst").alias("nodes")), found(t))


@query("AG15_bottleneck_edge", f"WITH {EDGE} SELECT cand, a, b, n FROM ec QUALIFY row_number() OVER (PARTITION BY cand ORDER BY n, pos) = 1")
def ag15_bottleneck(t):
    return corpus.bottleneck(corpus.edge_counts(candidates(t).select("cand", F.array("src", "mid", "dst").alias("nodes")), found(t)))


HOPS = f"""{COUNTS}, hp AS (SELECT cand, pair_sm AS sm, pair_md AS md, pair_sd AS sd, least(50, 10 * ((pair_sm > 2)::INT + (pair_md > 5)::INT + 1)) AS db_bonus FROM co),
ag AS (SELECT *, least(sm, md) AS chain_count_raw, least(sm, md) + db_bonus AS chain_count, CASE WHEN least(sm, md) + db_bonus <= 0 THEN 1 ELSE greatest(0, least(1, 1 - ln(1.0 + least(sm, md) + db_bonus) / ln(501.0))) END AS nov FROM hp)"""


def hops(t: Tables) -> DataFrame:
    c = corpus.counts(candidates(t), found(t))
    hit = lambda x: F.create_map(F.lit("a"), x, F.lit("b"), F.lit(False))
    each = [("source_mid", "pair_sm", F.col("pair_sm") > 2), ("mid_target", "pair_md", F.col("pair_md") > 5), ("source_target", "pair_sd", F.lit(True))]
    return c.select("cand", F.explode(F.array(*[F.struct(F.lit(h).alias("hop"), F.col(n).alias("count"), hit(x).alias("db_hits")) for h, n, x in each])).alias("h")).select("cand", "h.*")


@query("AG14_hop_aggregation", f"""WITH {HOPS} SELECT cand, sm AS source_mid, md AS mid_target, sd AS source_target, db_bonus, chain_count_raw, chain_count, round(nov, 4) AS chain_novelty, CASE WHEN sm <= md THEN 'source_mid' ELSE 'mid_target' END AS bottleneck,
    CASE WHEN nov > 0.7 THEN 'high' WHEN nov > 0.3 THEN 'moderate' ELSE 'low' END AS recommendation FROM ag""")
def ag14(t):
    return corpus.aggregated(hops(t))


@query("LT8_batch_evidence", f"WITH {HOPS} SELECT cand, chain_count FROM ag JOIN ca USING (cand) WHERE trim(src) != ''")
def lt8(t):
    named = candidates(t).filter(names.stripped(F.col("src")) != "").select("cand")
    return corpus.aggregated(hops(t)).join(named, "cand").select("cand", "chain_count")


@query("LT9_hop_sources", f"WITH {COUNTS} SELECT cand, CASE WHEN pair_sm > 0 AND pair_md > 0 THEN pair_sm || ' documents on the pair|' || pair_md || ' documents on the target' WHEN pair_sm > 0 THEN pair_sm || ' documents on the pair' WHEN pair_md > 0 THEN pair_md || ' documents on the target' ELSE '' END AS sources FROM co")
def lt9(t):
    c = corpus.counts(candidates(t), found(t))
    line = lambda n, what: F.when(F.col(n) > 0, F.concat(F.col(n), F.lit(f" documents on the {what}")))
    return c.select("cand", F.array_join(F.array_compact(F.array(line("pair_sm", "pair"), line("pair_md", "target"))), "|").alias("sources"))


def specs(t: Tables) -> DataFrame:
    """(spec, clause, term): for each candidate its source, and its intermediate or target."""
    c = candidates(t)
    return c.select(F.col("cand").alias("spec"), F.explode(F.array(F.struct(F.lit(0).alias("clause"), F.col("src").alias("term")), F.struct(F.lit(1).alias("clause"), F.col("mid").alias("term")), F.struct(F.lit(1).alias("clause"), F.col("dst").alias("term")))).alias("s")).select("spec", "s.*")


SPECS = f"""{FOUND}, sp AS (SELECT cand AS spec, 0 AS clause, src AS term FROM ca UNION ALL SELECT cand, 1, mid FROM ca UNION ALL SELECT cand, 1, dst FROM ca),
mt AS (SELECT spec, doc_id, count(DISTINCT term) AS score FROM sp JOIN fo USING (term) GROUP BY ALL HAVING count(DISTINCT clause) = 2),
rk AS (SELECT spec, doc_id, score, row_number() OVER (PARTITION BY spec ORDER BY score DESC, doc_id) AS nth FROM mt)"""


@query("LT10_term_set_retrieval", f"WITH {SPECS} SELECT spec, doc_id, score, nth FROM rk WHERE nth <= 40")
def lt10(t):
    return corpus.matching(specs(t), found(t))


@query("LT10_spec_log", f"WITH {SPECS} SELECT ca.cand AS spec, count(rk.doc_id) AS n FROM ca LEFT JOIN rk ON cand = spec AND nth <= 40 GROUP BY ca.cand")
def lt10_log(t):
    return corpus.spec_log(specs(t), corpus.matching(specs(t), found(t)))


@query("LT7_new_keys", "SELECT DISTINCT lang AS key FROM documents WHERE lang NOT IN (SELECT lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang = 'en')")
def lt7(t):
    stored = t.documents.join(t.labels, "doc_id").filter("toxic = 1 AND lang = 'en'").select(F.col("lang").alias("key"))
    return corpus.new_keys(t.documents.select(F.col("lang").alias("key")), stored, "key")


@query("LT7_stored_results", """SELECT c_custkey::VARCHAR AS key, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total, CASE WHEN c_mktsegment = 'BUILDING' THEN 'first' ELSE 'second' END AS computed
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment""")
def lt7_stored(t):
    path = shared_path(t.spark, "results")
    keys = lambda df: df.select(F.col("c_custkey").cast("string").alias("key"))

    def counted(run: str):
        sums = t.orders.groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        return lambda wanted: wanted.join(sums, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"), F.lit(run).alias("computed"))

    commits.results_of(keys(t.customer.filter("c_mktsegment = 'BUILDING'")), path, counted("first"))
    return commits.results_of(keys(t.customer), path, counted("second"))  # computes the new keys only


@query("LT6_alias_dictionary", "SELECT DISTINCT p_name AS name, unnest([p_name, split_part(p_name, ' ', 1)]) AS alias FROM part")
def lt6(t):
    return t.part.select(F.col("p_name").alias("name"), F.explode(names.aliases(F.col("p_name"))).alias("alias")).distinct()


SPEC_TEXTS = f"""{CAND}, fa AS (SELECT cand, 0 AS i, 'pair' AS family, '"' || src || '" AND "' || mid || '"' AS query FROM ca UNION ALL SELECT cand, 1, 'source_target', '"' || src || '" AND "colitis"' FROM ca
  UNION ALL SELECT cand, 2, 'mid_target', '"' || mid || '" AND "colitis"' FROM ca UNION ALL SELECT cand, 3, 'triple', '"' || src || '" AND "' || mid || '" AND "colitis"' FROM ca)"""


@query("SC11_query_set", f"WITH {SPEC_TEXTS}, uq AS (SELECT query, arg_min(family, (i, cand)) AS family, min((i, cand)) AS k FROM fa WHERE cand <= 60 GROUP BY query) SELECT family, query FROM uq ORDER BY k LIMIT 100")
def sc11(t):
    c = candidates(t).withColumn("cand_rank", F.col("cand")).drop("dst")
    return corpus.query_specs(c, "colitis").select("family", "query")


@query("SC12_round_two_specs", f"WITH {COUNTS} SELECT cand, unnest(['pair', 'target']) AS edge FROM co WHERE pair_sm = 0 AND pair_md = 0 UNION ALL SELECT cand, 'pair' FROM co WHERE pair_sm = 0 AND pair_md > 0 UNION ALL SELECT cand, 'target' FROM co WHERE pair_sm > 0 AND pair_md = 0")
def sc12(t):
    c = corpus.counts(candidates(t), found(t))
    every = c.select("cand", F.explode(F.array(F.lit("pair"), F.lit("target"))).alias("edge"))
    direct = c.select("cand", F.explode(F.array_compact(F.array(F.when(F.col("pair_sm") > 0, "pair"), F.when(F.col("pair_md") > 0, "target")))).alias("edge"))
    return every.join(direct, ["cand", "edge"], "left_anti")


@query("SC14_keyword_windows", f"WITH {CAND} SELECT item_id AS cand, w1.w || ' ' || w2.w AS query FROM fw w1 JOIN fw w2 USING (item_id) WHERE w2.nth = w1.nth + 1 AND w1.nth % 2 = 1 AND w1.nth <= 15")
def sc14(t):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))
    rows = t.benchmark.select(F.col("item_id").alias("cand"), F.slice(words, 1, 16).alias("w")).filter(F.size("w") >= 2)
    starts = F.sequence(F.lit(0), F.floor(F.size("w") / 2).cast("int") - 1)
    chunks = F.transform(starts, lambda i: F.array_join(F.slice("w", i * 2 + 1, 2), " "))
    return rows.select("cand", F.explode(chunks).alias("query"))


@query("ST4_merged_articles", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(text))")
def st4(t):
    rows = t.documents.select("doc_id", F.lit("").alias("pmid"), F.regexp_replace("text", "^ +| +$", "").alias("title"), F.lit(0).alias("list"), F.col("doc_id").alias("at"))
    return corpus.merged_articles(rows).select("doc_id")


@query("FL13_relevant_articles", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'license')::INT) >= 2 AND NOT contains(lower(text), 'password')")
def fl13(t):
    x = F.col("text")
    return t.documents.filter((texts.hits(x, ["the", "tion", "license"]) >= 2) & ~texts.any_of(x, ["password"])).select("doc_id")


# reference tables: part names against names and types


def table(t: Tables) -> DataFrame:
    """(row, source_name, target_name, edge_type, detail): one row per part."""
    return t.part.select(F.col("p_partkey").alias("row"), F.col("p_name").alias("source_name"), F.col("p_type").alias("target_name"), F.col("p_brand").alias("edge_type"), F.concat_ws("--", "p_name", "p_type").alias("detail"))


def asked(t: Tables) -> DataFrame:
    """(q): the words of part names, and each name with a word before it."""
    return t.part.select(F.explode(F.concat(F.split("p_name", " "), F.array(F.concat(F.lit("the "), "p_name")))).alias("q")).distinct()


ASKED = "q AS (SELECT DISTINCT unnest(list_concat(string_split(p_name, ' '), ['the ' || p_name])) AS q FROM part)"
MATCHED = f"{ASKED}, ma AS (SELECT q, p_partkey AS row, p_name, p_type, p_brand FROM q JOIN part ON contains(lower(p_name), lower(q)) OR contains(lower(q), lower(p_name)))"


@query("JN4_reference_matches", f"WITH {MATCHED} SELECT q, row FROM ma")
def jn4(t):
    return refmatch.matches(asked(t), table(t), "q", "source_name").select("q", "row")


@query("JN4_pair_matches", f"""WITH {MATCHED}, pr AS (SELECT DISTINCT unnest(list_concat(string_split(p_name, ' '), ['the ' || p_name])) AS q, lower(split_part(p_type, ' ', 1)) AS b FROM part)
    SELECT q, b, row FROM ma JOIN pr USING (q) WHERE contains(lower(p_type), b) OR contains(b, lower(p_type))""")
def jn4_pairs(t):
    words = F.concat(F.split("p_name", " "), F.array(F.concat(F.lit("the "), "p_name")))
    pairs = t.part.select(F.explode(words).alias("q"), F.lower(F.element_at(F.split("p_type", " "), 1)).alias("b")).distinct()
    return refmatch.pair_matches(pairs, table(t), "q", "b", "source_name", "target_name").select("q", "b", "row")


@query("FL5_synonym_predicate", "SELECT DISTINCT p_name, 'ec' AS q FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'ec')")
def fl5(t):
    q = t.spark.createDataFrame([("ec",)], "q string")
    forms = refmatch.with_synonyms(q, "q", {"ec": ["ring", "bolt"]})
    return refmatch.matches(forms.select("form"), table(t), "form", "source_name").join(forms, "form").select(F.col("source_name").alias("p_name"), "q").distinct()


@query("AG19_evidence_summary", f"""WITH {MATCHED} SELECT q, true AS hit, count(*) AS records, (SELECT string_agg(b, '|' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM ma m2 WHERE m2.q = ma.q)) AS edge_types,
    (SELECT string_agg(p_name || '--' || p_type, '|' ORDER BY row) FROM (SELECT * FROM ma m3 WHERE m3.q = ma.q ORDER BY row LIMIT 5)) AS details FROM ma GROUP BY q""")
def ag19(t):
    out = refmatch.evidence(refmatch.matches(asked(t), table(t), "q", "source_name"), ["q"])
    return out.select("q", "hit", "records", F.array_join("edge_types", "|").alias("edge_types"), F.array_join("details", "|").alias("details"))


@query("AG20_names_of_source", f"""WITH {MATCHED} SELECT q, count(*) AS records, (SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT DISTINCT p_type AS x FROM ma m2 WHERE m2.q = ma.q)) AS names, count(DISTINCT p_brand) AS n_sources FROM ma GROUP BY q""")
def ag20(t):
    out = refmatch.names_of(refmatch.matches(asked(t), table(t), "q", "source_name"), "q", "target_name", "edge_type")
    return out.select("q", "records", F.array_join("names", "|").alias("names"), F.size("sources").cast("long").alias("n_sources"))


@query("JN5_fallback_matches", f"""WITH q AS (SELECT DISTINCT 'zz' || p_brand AS q, p_name AS neighbour FROM part), d AS (SELECT DISTINCT p_name FROM part),
    f AS (SELECT q, min(neighbour) AS neighbour FROM q GROUP BY q) SELECT q, p_partkey AS row, neighbour AS method FROM f JOIN part ON contains(lower(p_name), lower(neighbour)) OR contains(lower(neighbour), lower(p_name))""")
def jn5(t):
    near = t.part.select(F.concat(F.lit("zz"), "p_brand").alias("q"), F.col("p_name").alias("neighbour")).distinct()
    first = near.groupBy("q").agg(F.min("neighbour").alias("first"))
    ranked = near.join(first, "q").select("q", "neighbour", F.when(F.col("neighbour") == F.col("first"), 1).otherwise(2).alias("rank"))
    return refmatch.with_fallback(near.select("q"), ranked, table(t), "q", "source_name").select("q", "row", "method")


BOTH_MATCH = "(contains(lower(p_name), lower(fa)) OR contains(lower(fa), lower(p_name))) AND (contains(lower(p_type), lower(fb)) OR contains(lower(fb), lower(p_type)))"


@query("JN5_pair_fallback", f"""WITH n AS (SELECT n, lead(n) OVER (ORDER BY n) AS nx FROM (SELECT DISTINCT p_name AS n FROM part)), y AS (SELECT y, lead(y) OVER (ORDER BY y) AS yx FROM (SELECT DISTINCT p_type AS y FROM part)),
    p AS (SELECT DISTINCT CASE WHEN o.p_size % 2 = 0 THEN o.p_name ELSE reverse(o.p_name) END AS a, CASE WHEN o.p_size % 3 = 0 THEN reverse(z.p_type) ELSE z.p_type END AS b FROM part o JOIN part z ON z.p_partkey = o.p_partkey + 1),
    a AS (SELECT DISTINCT a, 0 AS ra, a AS fa FROM p UNION ALL SELECT n, 1, nx FROM n UNION ALL SELECT reverse(n), 1, nx FROM n UNION ALL SELECT reverse(n), 2, n FROM n),
    b AS (SELECT DISTINCT b, 0 AS rb, b AS fb FROM p UNION ALL SELECT y, 1, yx FROM y UNION ALL SELECT reverse(y), 1, yx FROM y UNION ALL SELECT reverse(y), 2, y FROM y),
    m AS (SELECT p.a, p.b, ra, rb, p_partkey, rank() OVER (PARTITION BY p.a, p.b ORDER BY ra, rb) AS nth FROM p JOIN a USING (a) JOIN b USING (b) JOIN part ON {BOTH_MATCH})
    SELECT a, b, p_partkey AS row, ra AS rank_a, rb AS rank_b, CASE WHEN ra + rb = 0 THEN 'direct' ELSE 'neighbour' END AS method FROM m WHERE nth = 1""")
def jn5_pairs(t):
    after = t.part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_type").alias("then"))
    turned = lambda c, every: F.when(F.col("p_size") % every == (0 if every == 3 else 1), F.reverse(c)).otherwise(F.col(c))
    pairs = t.part.join(after, "p_partkey").select(turned("p_name", 2).alias("a"), turned("then", 3).alias("b"))

    def near(name):
        n = t.part.select(F.col(name).alias("n")).distinct()
        n = n.withColumn("then", F.lead("n").over(Window.orderBy("n")))  # distinct names of the vocabulary, not rows
        forms = [(F.col("n"), 1, "then"), (F.reverse("n"), 1, "then"), (F.reverse("n"), 2, "n")]
        return n.select(F.explode(F.array(*[F.struct(q.alias("query"), F.lit(r).alias("rank"), F.col(c).alias("neighbour")) for q, r, c in forms])).alias("x")).select("x.*")

    found = refmatch.pairs_with_fallback(pairs, near("p_name"), near("p_type"), table(t), "a", "b", "source_name", "target_name")
    return found.select("a", "b", "row", "rank_a", "rank_b", "method")


@query("ST3_entity_names", "SELECT DISTINCT trim(p_name) AS name, 'part' AS type FROM part UNION SELECT DISTINCT p_type, 'kind' FROM part UNION SELECT n_name, 'nation' FROM nation UNION SELECT r_name, 'nation' FROM region")
def st3(t):
    return embed.entity_names((t.part, "p_name", "part"), (t.part, "p_type", "kind"), (t.nation, "n_name", "nation"), (t.region, "r_name", "nation"))


@query("IO9_normalised_table", "SELECT p_partkey, lower(trim(p_name)) AS p_name, lower(trim(p_type)) AS p_type FROM part")
def io9(t):
    return refmatch.normalised(t.part.select("p_partkey", "p_name", "p_type"), "p_name", "p_type")


# embeddings

UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"


@query("EM1_unit_vectors", f"WITH {UNIT} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length, round(v[1], 6) AS first FROM u")
def em1(t):
    v = embed.unit(t.embeddings)
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"), F.round(F.element_at("embedding", 1), 6).alias("first"))


def vectors(t: Tables) -> DataFrame:
    return embed.unit(t.embeddings).select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"), F.col("embedding").alias("vector"))


NEAR = f"""{UNIT}, sc AS (SELECT a.vec_id AS qid, b.vec_id AS id, a.label, round(list_dot_product(a.v, b.v), 9) AS score FROM u a JOIN u b USING (label)),
rk AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc WHERE score >= 0.2)"""


@query("EM3_batch_retrieval", f"WITH {NEAR} SELECT qid, id, round(score, 5) AS score, rank FROM rk WHERE rank <= 5")
def em3(t):
    v = vectors(t)
    near, _ = embed.search(v.withColumnRenamed("id", "qid"), embed.Index(v), 5, 0.2)
    return near.select("qid", "id", F.round("score", 5).alias("score"), "rank")


@query("EM2_retrieval", f"""WITH {NEAR}, nm AS (SELECT qid, 'v' || (id // 2) AS name, max(score) AS score FROM rk WHERE rank <= 10 GROUP BY ALL),
    r2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name) AS rank FROM nm) SELECT qid, name, round(score, 5) AS score, rank FROM r2 WHERE rank <= 5""")
def em2(t):
    v = vectors(t).withColumn("name", F.concat(F.lit("v"), F.floor(F.col("id") / 2)))
    q = v.select(F.col("id").alias("qid"), "type", F.concat(F.lit("query "), "id").alias("name"), "vector")
    return embed.retrieve(q, v, 5, 0.2).select("qid", "name", F.round("score", 5).alias("score"), "rank")


@query("EM2_exact_stage", "SELECT item_id AS qid, p_name AS name, 1.0::DOUBLE AS score FROM (SELECT DISTINCT p_partkey AS item_id, p_name FROM part)")
def em2_exact(t):
    q = t.part.select(F.col("p_partkey").alias("qid"), F.lit("part").alias("type"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))
    return embed.exact(q, t.part.select(F.col("p_name").alias("name"), F.lit("part").alias("type")))


# catalogue


def records(t: Tables) -> DataFrame:
    """run_id, src, mid, ... : events grouped by user, with quadrants by type."""
    quad = F.element_at(F.array(*map(F.lit, quadrant.ORDER)), F.pmod(F.length("event_type"), F.lit(4)) + 1)
    return t.events.select(
        F.concat(F.lit("run"), "user_id").alias("run_id"), F.concat(F.lit("s"), "event_type").alias("src"), F.concat(F.lit("m"), "event_id").alias("mid"), F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.lit("IBD")).alias("target"), quad.alias("quadrant"),
        F.round("value", 2).alias("composite_score"), F.col("value").alias("signal"), (F.col("value") / 10).alias("novelty"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


RECORDS = """re AS (SELECT 'run' || user_id AS run_id, 's' || event_type AS src, 'm' || event_id AS mid, CASE WHEN event_type = 'error' THEN '' ELSE 'IBD' END AS target, ['I', 'II', 'III', 'IV'][length(event_type) % 4 + 1] AS quadrant,
  round(value, 2) AS composite_score, value AS signal, value / 10 AS novelty, strftime(ts, '%Y-%m-%d') AS day FROM events),
mt AS (SELECT run_id, max(target) AS target, count(*) AS candidate_count, max(day) AS created_at FROM re GROUP BY run_id),
ix AS (SELECT run_id, src, mid, coalesce(nullif(re.target, ''), mt.target) AS target, quadrant, composite_score, signal, novelty, created_at AS computed_at FROM re JOIN mt USING (run_id))"""


def meta(t: Tables) -> DataFrame:
    r = records(t)
    return catalog.run_meta(r.withColumn("target", F.nullif("target", F.lit(""))), "target", "day")


def full_index(t: Tables) -> DataFrame:
    return catalog.index(records(t), meta(t).withColumn("target", F.coalesce("target", F.lit(""))))


@query("CT1_run_meta", f"""WITH {RECORDS}, h AS (SELECT run_id, arg_min(src, (-n, src)) AS source_hint FROM (SELECT run_id, src, count(*) AS n FROM re GROUP BY ALL) GROUP BY run_id)
    SELECT run_id, candidate_count, source_hint, created_at FROM mt JOIN h USING (run_id)""")
def ct1(t):
    return meta(t).select("run_id", "candidate_count", "source_hint", "created_at")


@query("CT1_archived_runs", f"""WITH {RECORDS} SELECT run_id, src, mid, CASE WHEN run_id >= 'run5' THEN 'II' ELSE quadrant END AS quadrant, target, CASE WHEN run_id >= 'run5' THEN 2 ELSE 1 END AS "commit", candidate_count
    FROM ix JOIN (SELECT run_id, candidate_count FROM mt) USING (run_id)""")
def ct1_archived(t):
    root, index, about = shared_path(t.spark, "archive"), full_index(t), meta(t)
    commits.archive_runs(t.spark, root, {"candidates": index, "meta": about})
    again = F.col("run_id") >= "run5"  # runs that are done anew
    commits.archive_runs(t.spark, root, {"candidates": index.filter(again).withColumn("quadrant", F.lit("II")), "meta": about.filter(again)})
    commits.remove_stale(t.spark, root)
    live = commits.snapshot(t.spark, root).filter("name = 'candidates'").select("run_id", "commit")
    rows = commits.archived(t.spark, root, "candidates").join(commits.archived(t.spark, root, "meta").select("run_id", "candidate_count"), "run_id")
    return rows.join(live, "run_id").select("run_id", "src", "mid", "quadrant", "target", "commit", "candidate_count")


@query("CT2_flat_index", f"WITH {RECORDS} SELECT * FROM ix")
def ct2(t):
    return full_index(t)


@query("TK5_catalogue_order", f"WITH {RECORDS} SELECT run_id, src, mid FROM ix ORDER BY computed_at DESC, composite_score DESC, run_id, src, mid LIMIT 200")
def tk5(t):
    return catalog.newest_first(full_index(t)).select("run_id", "src", "mid").limit(200)


@query("FL12_catalogue_predicates", f"WITH {RECORDS} SELECT run_id, src, mid FROM ix WHERE quadrant = 'II' AND contains(lower(src), 'c') AND (contains(lower(src), 'm1') OR contains(lower(mid), 'm1') OR contains(lower(target), 'm1'))")
def fl12(t):
    return catalog.matching(full_index(t), q="M1", src="C", quadrant="II").select("run_id", "src", "mid")


@query("CT3_search", f"WITH {RECORDS} SELECT run_id, src, mid, quadrant FROM ix WHERE contains(lower(target), 'ibd') ORDER BY array_position(['I', 'II', 'III', 'IV'], quadrant), signal DESC, run_id, src, mid LIMIT 100 OFFSET 50")
def ct3(t):
    return catalog.search(full_index(t), target="ibd", limit=100, offset=50).select("run_id", "src", "mid", "quadrant")


@query("TK4_page_with_total", f"WITH {RECORDS} SELECT count(*) AS total FROM ix WHERE contains(lower(mid), '7')")
def tk4(t):
    return catalog.matching(full_index(t), mid="7").agg(F.count(F.lit(1)).alias("total"))


@query("CT4_run_list", f"WITH {RECORDS} SELECT run_id, created_at FROM mt ORDER BY created_at DESC, run_id LIMIT 500")
def ct4(t):
    return catalog.run_list(meta(t)).select("run_id", "created_at").limit(500)


@query("CT5_record_detail", f"WITH {RECORDS} SELECT run_id, src, mid, round(signal, 6) AS signal, round(novelty, 6) AS novelty, quadrant FROM ix")
def ct5(t):
    d = catalog.detail(full_index(t))
    return d.select("run_id", "src", "mid", F.round("scores.signal", 6).alias("signal"), F.round("scores.novelty", 6).alias("novelty"), "place.quadrant")


@query("CT6_export_documents", f"""WITH {RECORDS} SELECT run_id, src, mid, run_id AS doc_run, src AS doc_src, mid AS doc_mid, round(signal, 6) AS signal, round(novelty, 6) AS novelty, round(composite_score, 6) AS score, quadrant, target,
    'mid,place,run_id,scores,src' AS fields FROM ix""")
def ct6(t):
    d = catalog.exported(full_index(t))
    text = {"doc_run": "run_id", "doc_src": "src", "doc_mid": "mid", "quadrant": "place.quadrant", "target": "place.target"}
    number = {"signal": "signal", "novelty": "novelty", "score": "composite_score"}
    at = lambda path: F.get_json_object("document", f"$.{path}")
    found = [at(p).alias(n) for n, p in text.items()] + [F.round(at(f"scores.{p}").cast("double"), 6).alias(n) for n, p in number.items()]
    return d.select("run_id", "src", "mid", *found, F.array_join(F.sort_array(F.json_object_keys("document")), ",").alias("fields"))


@query("CT7_dashboard_view", f"WITH {RECORDS} SELECT run_id, mid, quadrant, signal > (SELECT median(signal) FROM ix) AS above FROM ix")
def ct7(t):
    ix = full_index(t)
    return ix.crossJoin(F.broadcast(quadrant.medians(ix, m="signal"))).select("run_id", "mid", "quadrant", (F.col("signal") > F.col("m")).alias("above"))


@query("JN1_latest_value", """SELECT l_orderkey, l_linenumber, coalesce(x.latest, l_tax) AS l_tax FROM lineitem LEFT JOIN (SELECT o_orderkey, arg_max(o_totalprice, o_orderdate) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderkey) x ON l_orderkey = o_orderkey""")
def jn1(t):
    latest = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("l_tax"), F.col("o_orderdate").alias("at"))
    return catalog.with_latest(t.lineitem.select("l_orderkey", "l_linenumber", "l_tax"), latest, ["l_orderkey"], "l_tax")


@query("JN2_merged_stages", """SELECT o_orderkey, coalesce(s.o, o_orderstatus) AS status, s.n AS evidence_n FROM orders LEFT JOIN (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS o, count(*) AS n FROM lineitem GROUP BY l_orderkey) s ON o_orderkey = l_orderkey""")
def jn2(t):
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", "returned")).alias("status"), F.count(F.lit(1)).alias("n"))
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return catalog.merged_stages(rows, items.select("o_orderkey", "status"), items.select("o_orderkey", "n"), ["o_orderkey"], ["status"])


@query("JN3_nested_keys", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'top' WHEN event_type = 'view' THEN 'row' ELSE 'candidate' END AS name FROM events")
def jn3(t):
    kind = F.col("event_type")
    rows = t.events.select("event_id", F.when(kind == "click", "top").alias("name"), F.struct(F.when(kind == "view", "row").alias("name")).alias("row"), F.struct(F.lit("candidate").alias("name")).alias("candidate"))
    return rows.select("event_id", catalog.nested_key("name", "row", "candidate").alias("name"))


@query("ST8_record_dedupe", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def st8(t):
    return catalog.first_of(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"])


@query("ST5_set_sizes", "SELECT count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_first, count(*) FILTER (WHERE b AND NOT a) AS n_second FROM (SELECT k, bool_or(x) AS a, bool_or(NOT x) AS b FROM (SELECT l_partkey AS k, true AS x FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, false FROM lineitem WHERE l_returnflag = 'A') GROUP BY k)")
def st5(t):
    return catalog.set_sizes(t.lineitem.filter("l_returnflag = 'R'"), t.lineitem.filter("l_returnflag = 'A'"), "l_partkey")


@query("ST2_union_of_scenarios", "SELECT 'R' AS scenario, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'A', count(*) FROM lineitem WHERE l_returnflag = 'A'")
def st2(t):
    one = lambda f: t.lineitem.filter(F.col("l_returnflag") == f).agg(F.lit(f).alias("scenario"), F.count(F.lit(1)).alias("n"))
    return one("R").unionByName(one("A"))
