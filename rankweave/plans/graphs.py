"""Queries of graph, path and energy operators.

Nodes are regions, nations, suppliers, brands and part types; edges lead from
region to nation, nation to supplier, supplier to brand (from line items, with
impact, citations and year) and brand to type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import energy, graph
from .registry import Tables, query

YEAR = 2026


def nodes(t: Tables) -> DataFrame:
    one = lambda df, key, letter, label, kind: df.select(F.concat(F.lit(letter), key).alias("id"), F.col(label).alias("label"), F.lit(kind).alias("type")).distinct()
    out = one(t.region, "r_regionkey", "R", "r_name", "region").unionByName(one(t.nation, "n_nationkey", "N", "n_name", "nation")).unionByName(one(t.supplier, "s_suppkey", "S", "s_name", "supplier"))
    return out.unionByName(one(t.part, "p_brand", "B:", "p_brand", "brand")).unionByName(one(t.part, "p_type", "T:", "p_type", "type"))


def edges(t: Tables) -> DataFrame:
    none = {"impact": F.lit(None).cast("double"), "cites": F.lit(None).cast("long"), "year": F.lit(None).cast("int")}
    cols = ["source", "target", "relation", "impact", "cites", "year"]
    a = t.nation.select(F.concat(F.lit("R"), "n_regionkey").alias("source"), F.concat(F.lit("N"), "n_nationkey").alias("target"), F.lit("holds").alias("relation")).withColumns(none)
    b = t.supplier.select(F.concat(F.lit("N"), "s_nationkey").alias("source"), F.concat(F.lit("S"), "s_suppkey").alias("target"), F.lit("hosts").alias("relation")).withColumns(none)
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    c = items.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("B:"), "p_brand").alias("target")).agg(F.max("l_tax").alias("impact"), F.count(F.lit(1)).alias("cites"), F.max(F.year("l_shipdate")).alias("year")).withColumn("relation", F.lit("sells"))
    d = t.part.groupBy(F.concat(F.lit("B:"), "p_brand").alias("source"), F.concat(F.lit("T:"), "p_type").alias("target")).agg(F.lit(0.0).alias("impact"), F.count(F.lit(1)).alias("cites")).withColumns({"relation": F.lit("makes"), "year": F.lit(None).cast("int")})
    return a.select(cols).unionByName(b.select(cols)).unionByName(c.select(cols)).unionByName(d.select(cols))


GRAPH = """ed AS (
  SELECT 'R' || n_regionkey AS source, 'N' || n_nationkey AS target, 'holds' AS relation, NULL::DOUBLE AS impact, NULL::BIGINT AS cites, NULL::INT AS year FROM nation
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'hosts', NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'S' || l_suppkey, 'B:' || p_brand, 'sells', max(l_tax), count(*), max(year(l_shipdate)) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
  UNION ALL SELECT 'B:' || p_brand, 'T:' || p_type, 'makes', 0.0, count(*), NULL FROM part GROUP BY 1, 2),
nd AS (
  SELECT 'R' || r_regionkey AS id, r_name AS label, 'region' AS type FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'nation' FROM nation
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT DISTINCT 'B:' || p_brand, p_brand, 'brand' FROM part UNION ALL SELECT DISTINCT 'T:' || p_type, p_type, 'type' FROM part),
un AS (SELECT source, target, relation, true AS forward FROM ed UNION ALL SELECT target, source, relation, false FROM ed),
dg AS (SELECT source AS id, count(*) AS degree, count_if(forward) AS out_degree FROM un GROUP BY source)"""


@query("AG6_graph_statistics", f"WITH {GRAPH} SELECT 'node' AS kind, type AS name, count(*) AS n FROM nd GROUP BY CUBE (type) UNION ALL SELECT 'edge', relation, count(*) FROM ed GROUP BY CUBE (relation)")
def ag6(t):
    return graph.stats(nodes(t), edges(t))


@query("AG7_degrees", f"WITH {GRAPH} SELECT id, degree, out_degree FROM dg")
def ag7(t):
    return graph.degrees(edges(t))


CREDIBILITY = f"{GRAPH}, cr AS (SELECT id, coalesce(avg(impact) FILTER (WHERE impact != 0), 1.0) AS credibility FROM (SELECT source AS id, impact FROM ed UNION ALL SELECT target, impact FROM ed) GROUP BY id)"


@query("AG8_credibility", f"WITH {CREDIBILITY} SELECT id, round(credibility, 6) AS credibility FROM cr")
def ag8(t):
    return energy.credibility(edges(t)).select("id", F.round("credibility", 6).alias("credibility"))


SUPPORT = f"""{CREDIBILITY}, su AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(coalesce(impact * cites / (coalesce(greatest({YEAR} - year, 0), 5) + 1), 0)) AS support FROM ed GROUP BY 1, 2)"""


@query("AG9_edge_support", f"WITH {SUPPORT} SELECT a, b, round(support, 6) AS support, round(1 / (1 + support), 6) AS resistance FROM su")
def ag9(t):
    return energy.supports(edges(t), YEAR).select("a", "b", F.round("support", 6).alias("support"), F.round("resistance", 6).alias("resistance"))


@query("GR9_neighbours", f"WITH {GRAPH} SELECT source AS id, target AS neighbour, relation, forward FROM un")
def gr9(t):
    return graph.neighbours(edges(t))


@query("GR10_edge_lookup", f"WITH {GRAPH} SELECT source, target, relation, cites FROM ed WHERE source = 'S1' AND target LIKE 'B:%'")
def gr10(t):
    return edges(t).filter("source = 'S1' AND target LIKE 'B:%'").select("source", "target", "relation", "cites")


def directed_paths(t: Tables) -> DataFrame:
    """From regions to the brands that suppliers there sell: region, nation, supplier, brand."""
    sold = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_brand").distinct()
    held = sold.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    pairs = held.select(F.concat(F.lit("R"), "n_regionkey").alias("start"), F.concat(F.lit("B:"), "p_brand").alias("end")).distinct()
    return graph.simple_paths(edges(t), pairs, 3)


PATHS = f"""{GRAPH}, pa AS (SELECT a.source AS start, c.target AS "end", a.source || ' -[holds]-> ' || a.target || ' -[hosts]-> ' || b.target || ' -[sells]-> ' || c.target AS path, 3 AS length, [a.source, a.target, b.target, c.target] AS nodes
  FROM ed a JOIN ed b ON a.target = b.source JOIN ed c ON b.target = c.source WHERE a.relation = 'holds' AND b.relation = 'hosts' AND c.relation = 'sells')"""


@query("GR6_directed_paths", f'WITH {PATHS} SELECT start, "end", path, length FROM pa')
def gr6(t):
    return directed_paths(t).select("start", "end", graph.path_text().alias("path"), "length")


@query("TK7_shortest_paths", f'WITH {PATHS} SELECT start, "end", path, nth FROM (SELECT *, row_number() OVER (PARTITION BY start, "end" ORDER BY length, path) AS nth FROM pa) WHERE nth <= 5')
def tk7(t):
    return graph.shortest(directed_paths(t)).select("start", "end", graph.path_text().alias("path"), "nth")


@query(
    "GR7_undirected_paths",
    f"""WITH {GRAPH}, ask AS (SELECT 'N' || c_nationkey AS start, arg_min('B:' || p_brand, (-n, p_brand)) AS "end" FROM (SELECT c_nationkey, p_brand, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY c_nationkey),
    un2 AS (SELECT DISTINCT source, target, relation FROM un), inner_step AS (SELECT * FROM un2 WHERE target NOT LIKE 'R%'),
    p1 AS (SELECT start, "end", u.relation AS r1 FROM ask JOIN un2 u ON source = start AND target = "end"),
    h AS (SELECT start, "end", a.target AS x, a.relation AS r1, b.target AS y, b.relation AS r2 FROM ask JOIN inner_step a ON a.source = start JOIN un2 b ON b.source = a.target WHERE a.target != "end" AND b.target != start),
    i AS (SELECT h.*, c.target AS z, c.relation AS r3 FROM h JOIN un2 c ON c.source = y WHERE y != "end" AND y NOT LIKE 'R%' AND c.target NOT IN (start, x)),
    j AS (SELECT i.*, d.target AS w, d.relation AS r4 FROM i JOIN un2 d ON d.source = z AND d.target = "end" WHERE z != "end" AND z NOT LIKE 'R%'),
    pa AS (SELECT start, "end", 1 AS length, start || ' -[' || r1 || ']-> ' || "end" AS path FROM p1
      UNION ALL SELECT start, "end", 2, start || ' -[' || r1 || ']-> ' || x || ' -[' || r2 || ']-> ' || y FROM h WHERE y = "end"
      UNION ALL SELECT start, "end", 3, start || ' -[' || r1 || ']-> ' || x || ' -[' || r2 || ']-> ' || y || ' -[' || r3 || ']-> ' || z FROM i WHERE z = "end"
      UNION ALL SELECT start, "end", 4, start || ' -[' || r1 || ']-> ' || x || ' -[' || r2 || ']-> ' || y || ' -[' || r3 || ']-> ' || z || ' -[' || r4 || ']-> ' || w FROM j)
    SELECT start, "end", path FROM (SELECT *, row_number() OVER (PARTITION BY start, "end" ORDER BY length, path) AS nth FROM pa) WHERE nth <= 5""",
)
def gr7(t):
    """From each nation to the brand that its customers buy most, by at most four edges and through no region."""
    bought = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    counts = bought.groupBy("c_nationkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("n")).alias("n"), "p_brand")).alias("m"))
    pairs = most.select(F.concat(F.lit("N"), "c_nationkey").alias("start"), F.concat(F.lit("B:"), "m.p_brand").alias("end"))
    found = graph.simple_paths(edges(t), pairs, 4, directed=False, between=graph.without_intermediates(nodes(t), "region"), k=5)
    return graph.shortest(found).select("start", "end", graph.path_text().alias("path"))


@query(
    "GR8_khop_neighbourhood",
    f"""WITH {GRAPH}, h0 AS (SELECT id, 0 AS hop FROM nd WHERE type = 'nation'), h1 AS (SELECT DISTINCT target AS id, 1 AS hop FROM un JOIN h0 ON source = id WHERE target NOT IN (SELECT id FROM h0)),
    h2 AS (SELECT DISTINCT target AS id, 2 AS hop FROM un JOIN h1 ON source = id WHERE target NOT IN (SELECT id FROM h0 UNION ALL SELECT id FROM h1)) SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2""",
)
def gr8(t):
    return graph.khop(edges(t), nodes(t).filter("type = 'nation'").select("id"), 2)


@query("FL10_induced_subgraph", f"WITH {GRAPH} SELECT source, target, relation FROM ed WHERE source IN (SELECT id FROM nd WHERE type IN ('nation', 'supplier')) AND target IN (SELECT id FROM nd WHERE type IN ('nation', 'supplier'))")
def fl10(t):
    return graph.induced(edges(t), nodes(t).filter("type IN ('nation', 'supplier')")).select("source", "target", "relation")


@query("FL11_type_view", f"WITH {GRAPH} SELECT id FROM nd WHERE type = 'brand' UNION SELECT target FROM un JOIN nd ON source = id WHERE type = 'brand'")
def fl11(t):
    return graph.type_view(nodes(t), edges(t), "brand")


@query("TK6_top_neighbours", f"""WITH {GRAPH}, ne AS (SELECT DISTINCT source AS core, target AS id FROM un WHERE source LIKE 'N%')
    SELECT core, id FROM (SELECT core, ne.id, row_number() OVER (PARTITION BY core ORDER BY degree DESC, ne.id) AS nth FROM ne JOIN dg ON ne.id = dg.id) WHERE nth <= 6""")
def tk6(t):
    return graph.top_neighbours(edges(t), nodes(t).filter("type = 'nation'"), 6)


@query("GR3_resolve_names", f"WITH {GRAPH} SELECT name, min(id) AS id FROM (SELECT n_name AS name FROM nation) JOIN nd ON contains(lower(replace(label, '_', ' ')), lower(replace(name, '_', ' '))) OR contains(lower(replace(name, '_', ' ')), lower(replace(label, '_', ' '))) WHERE label != '' GROUP BY name")
def gr3(t):
    return graph.resolve(t.nation.select(F.col("n_name").alias("name")), nodes(t)).select("name", "id")


@query("GR4_resolve_exact", f"WITH {GRAPH} SELECT p_type AS name, 'type' AS type, 'T:' || p_type AS id FROM part GROUP BY ALL")
def gr4(t):
    return graph.resolve_exact(t.part.select(F.col("p_type").alias("name"), F.lit("type").alias("type")), nodes(t))


@query("GR5_best_substring", f"""WITH {GRAPH}, w AS (SELECT DISTINCT lower(p_brand[1:7]) AS name FROM part)
    SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY length(name) / length(label) DESC, id) AS nth FROM w JOIN nd ON contains(lower(replace(replace(label, '-', ' '), '_', ' ')), name)) WHERE nth = 1""")
def gr5(t):
    return graph.best_substring(t.part.select(F.lower(F.substring("p_brand", 1, 7)).alias("name")), nodes(t))


def chain_triples(t: Tables) -> DataFrame:
    """One triple per supplier: its nation, itself, and its best-sold brand."""
    e = edges(t)
    sold = e.filter("relation = 'sells'").groupBy(F.col("source").alias("mid")).agg(F.max_by("target", F.struct("cites", "target")).alias("dst"))
    return e.filter("relation = 'hosts'").select(F.col("target").alias("mid"), F.col("source").alias("src")).join(sold, "mid").select(F.col("mid").alias("triple"), "src", "mid", "dst")


TRIPLES = f"""{GRAPH}, so AS (SELECT source AS mid, arg_max(target, (cites, target)) AS dst FROM ed WHERE relation = 'sells' GROUP BY source),
tr AS (SELECT ed.target AS triple, ed.source AS src, ed.target AS mid, dst FROM ed JOIN so ON ed.target = so.mid WHERE relation = 'hosts')"""


@query("GR11_chain_subgraph", f"""WITH {TRIPLES}, co AS (SELECT triple, unnest([src, mid, dst]) AS id FROM tr)
    SELECT e.triple, ed.source, ed.target, ed.relation, true AS is_chain FROM co e JOIN co f USING (triple) JOIN ed ON ed.source = e.id AND ed.target = f.id""")
def gr11(t):
    return graph.chain_subgraph(edges(t), chain_triples(t), focused=True)[1].select("triple", "source", "target", "relation", "is_chain")


@query("GR12_downgraded_relations", f"WITH {GRAPH} SELECT source, target, CASE WHEN relation = 'sells' AND year >= 2000 THEN 'associated_with' ELSE relation END AS relation FROM ed")
def gr12(t):
    e = edges(t).withColumn("description", F.when(F.col("year") >= 2000, "an observational cohort").otherwise("a trial"))
    return graph.downgraded(e, nodes(t), "supplier", "brand", "sells", ["observational", "cross-sectional"]).select("source", "target", "relation")


@query("GR13_hop_types", f"WITH {GRAPH} SELECT id, CASE type WHEN 'supplier' THEN 'source_mid|mid_target' WHEN 'nation' THEN 'source_mid|source_target' ELSE '' END AS hops FROM nd")
def gr13(t):
    n = nodes(t).withColumn("role", F.when(F.col("type") == "supplier", "mid").when(F.col("type") == "nation", "source").otherwise("other"))
    return n.select("id", F.array_join(graph.hop_types(), "|").alias("hops"))


@query("GR14_enriched_edges", f"WITH {GRAPH} SELECT source, target, CASE WHEN relation = 'hosts' THEN s_acctbal END AS impact FROM ed LEFT JOIN supplier ON 'S' || s_suppkey = target")
def gr14(t):
    e = edges(t).drop("impact", "cites", "year").withColumn("pmids", F.when(F.col("relation") == "hosts", F.array("target", F.lit("x"))).otherwise(F.array().cast("array<string>")))
    works = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("pmid"), F.col("s_acctbal").alias("impact"), F.col("s_suppkey").alias("cites"), F.lit(2000).alias("year"))
    return graph.enriched(e, works).select("source", "target", "impact")


@query("JN10_first_work_of_edges", """WITH e AS (SELECT 'S' || l_suppkey AS source, 'B:' || p_brand AS target, min(l_orderkey) AS pmid FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    SELECT source, target, CASE WHEN pmid % 2 = 0 THEN o_totalprice END AS impact, CASE WHEN pmid % 2 = 0 THEN o_custkey END AS cites FROM e LEFT JOIN orders ON o_orderkey = pmid""")
def jn10(t):
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    ids = F.array(F.min("l_orderkey").cast("string"), F.max("l_orderkey").cast("string"))
    e = items.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("B:"), "p_brand").alias("target")).agg(ids.alias("pmids"))
    # half of the works are unknown; an edge whose first one is gets nothing from its second
    works = t.orders.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("pmid"), F.col("o_totalprice").alias("impact"), F.col("o_custkey").alias("cites"), F.year("o_orderdate").alias("year"))
    return graph.enriched(e, works).select("source", "target", "impact", "cites")


@query("GR15_pair_facts", f"""WITH {TRIPLES} SELECT src AS start, mid AS "end", 'hosts' AS direct, src || ' -[hosts]-> ' || mid AS path, (SELECT count(DISTINCT target) FROM ed WHERE ed.source = tr.mid AND relation = 'sells') AS n_onward FROM tr""")
def gr15(t):
    pairs = chain_triples(t).select(F.col("src").alias("start"), F.col("mid").alias("end"))
    out = graph.pair_facts(edges(t), pairs, nodes(t), "brand", 2)
    return out.select("start", "end", F.array_join("direct", "|").alias("direct"), F.element_at("paths", 1).alias("path"), F.size("onward").cast("long").alias("n_onward"))


@query("GR16_path_nodes", f"WITH {TRIPLES} SELECT triple, src || '|' || mid || '|' || dst AS nodes FROM tr")
def gr16(t):
    step = lambda a, b: F.struct(F.col(a).alias("src"), F.lit("r").alias("rel"), F.col(b).alias("dst"))
    return chain_triples(t).select("triple", F.array_join(graph.node_order(F.array(step("src", "mid"), step("mid", "dst"))), "|").alias("nodes"))


@query("JN11_node_evidence", f"""WITH {GRAPH}, ev AS (SELECT id, ed.* FROM nd JOIN ed ON id = source OR id = target WHERE type = 'supplier')
    SELECT id, source, target, row_number() OVER (PARTITION BY id ORDER BY coalesce(cites, 0) DESC, source, target) AS nth FROM ev""")
def jn11(t):
    e = edges(t).withColumn("n_ids", F.lit(1)).withColumn("cites", F.coalesce("cites", F.lit(0)))
    return graph.node_evidence(e, nodes(t), nodes(t).filter("type = 'supplier'")).select("id", "source", "target", "nth")


@query("TK9_evidence_order", f"""WITH {GRAPH}, ev AS (SELECT id, ed.* FROM nd JOIN ed ON id = source OR id = target WHERE type = 'brand')
    SELECT id, source, target, nth FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(relation) DESC, cites DESC, source, target) AS nth FROM ev) WHERE nth <= 10""")
def tk9(t):
    e = edges(t).withColumn("n_ids", F.length("relation"))
    return graph.node_evidence(e, nodes(t), nodes(t).filter("type = 'brand'")).filter("nth <= 10").select("id", "source", "target", "nth")


ALIASES = f"{GRAPH}, al AS (SELECT 'T:' || p_type AS id, 'T:' || min(p_type) OVER (PARTITION BY length(p_type)) AS canonical FROM (SELECT DISTINCT p_type FROM part))"


@query("JN16_GR2_alias_collapse", f"""WITH {ALIASES} SELECT source, coalesce(canonical, target) AS target, arg_max(cites, (cites, target)) AS cites FROM ed LEFT JOIN al ON target = al.id WHERE source != coalesce(canonical, target) GROUP BY 1, 2""")
def jn16(t):
    types = t.part.select("p_type").distinct()
    first = types.groupBy(F.length("p_type").alias("n")).agg(F.min("p_type").alias("first"))
    alias = types.withColumn("n", F.length("p_type")).join(first, "n").select(F.concat(F.lit("T:"), "p_type").alias("id"), F.concat(F.lit("T:"), "first").alias("canonical"))
    e = edges(t).select("source", "target", "cites", F.struct("cites", "target").alias("at"))
    return graph.collapsed(e, alias)


@query(
    "GR1_built_graph",
    """WITH e AS (SELECT 'C' || o_custkey AS source, 'P' || o_orderpriority AS target, arg_min(o_orderstatus, o_orderkey) AS relation, count(*) AS n FROM orders GROUP BY ALL) SELECT source, target, relation, n AS n_ids FROM e""",
)
def gr1(t):
    rows = t.orders.select(
        F.lit("edge").alias("kind"), F.col("o_orderkey").alias("at"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("description"),
        F.concat(F.lit("C"), "o_custkey").alias("source"), F.concat(F.lit("P"), "o_orderpriority").alias("target"), F.col("o_orderstatus").alias("relation"), F.col("o_orderkey").cast("string").alias("pmid"),
    )
    return graph.built(rows)[1].select("source", "target", "relation", F.size("pmids").cast("long").alias("n_ids"))


SCORES = f"""{SUPPORT.replace('su AS', 'w AS (SELECT dg.id, CASE WHEN out_degree = 0 THEN 1.0 ELSE 0.0 END AS new, CASE WHEN out_degree = 0 THEN 1 + credibility ELSE 0 END AS weight FROM dg JOIN cr USING (id)), su AS')},
ch AS (SELECT b.source || '>' || b.target || '>' || c.target AS path_id, b.source AS s, b.target AS m, c.target AS d FROM ed b JOIN ed c ON b.target = c.source WHERE b.relation = 'sells'),
ps AS (SELECT path_id, s, d, ws.new + wm.new + wd.new AS n, ws.weight ** 2 + wm.weight ** 2 + wd.weight ** 2 AS squares, 1 / (1 + coalesce(e1.support, 0)) + 1 / (1 + coalesce(e2.support, 0)) AS resistance
  FROM ch JOIN w ws ON s = ws.id JOIN w wm ON m = wm.id JOIN w wd ON d = wd.id LEFT JOIN su e1 ON e1.a = least(s, m) AND e1.b = greatest(s, m) LEFT JOIN su e2 ON e2.a = least(m, d) AND e2.b = greatest(m, d)),
sc AS (SELECT path_id, s, d, sqrt(n) * squares AS energy, resistance, CASE WHEN sqrt(n) * squares > 0 THEN sqrt(n) * squares / resistance ELSE 1 / resistance END AS score FROM ps)"""


def sell_paths(t: Tables) -> DataFrame:
    e = edges(t)
    b = e.filter("relation = 'sells'").select(F.col("source").alias("s"), F.col("target").alias("m"))
    c = e.filter("relation = 'makes'").select(F.col("source").alias("m"), F.col("target").alias("d"))
    return b.join(c, "m").select(F.concat_ws(">", "s", "m", "d").alias("path_id"), "s", "d", F.array("s", "m", "d").alias("nodes"))


@query("AG10_path_energy", f"WITH {SCORES} SELECT path_id, round(score, 5) AS score, round(energy, 5) AS energy, round(resistance, 5) AS resistance FROM sc")
def ag10(t):
    out = energy.path_scores(edges(t), sell_paths(t), YEAR)
    return out.select("path_id", *[F.round(c, 5).alias(c) for c in ("score", "energy", "resistance")])


@query("AG11_best_path", f"WITH {SCORES} SELECT s, d, arg_min(path_id, (-round(score, 9), path_id)) AS path_id, round(max(score), 5) AS score FROM sc WHERE score > 0 GROUP BY s, d")
def ag11(t):
    paths = sell_paths(t)
    scores = energy.path_scores(edges(t), paths.select("path_id", "nodes"), YEAR).select("path_id", F.round("score", 9).alias("score"))
    return energy.best_paths(scores, paths, ["s", "d"]).withColumn("score", F.round("score", 5))
