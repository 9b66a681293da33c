"""Queries of name and text functions over parts, suppliers, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, texts
from .registry import query

STOP = ["the", "and", "than", "with", "that", "this", "from", "was", "are", "which"]


def joined(c, sep: str = "|"):
    return F.array_join(c, sep)


FILE = "'out/run0_min' || s_suppkey || '_Genus_species' || s_nationkey || '_seed_1_dim.csv'"


@query("SC1_source_from_file_name", f"SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'Genus_species' ELSE 'Genus_species' || s_nationkey END AS src FROM supplier")
def sc1(t):
    k = F.col("s_suppkey")
    file = F.when(k % 3 == 2, F.concat(F.lit("a/b_c"), k, F.lit(".csv"))).when(k % 3 == 1, F.lit("x/plus_Genus_species_seed_1.csv")).otherwise(F.concat(F.lit("out/run0_min"), k, F.lit("_Genus_species"), "s_nationkey", F.lit("_seed_1_dim.csv")))
    return t.supplier.select("s_suppkey", names.from_file_name(file).alias("src"))


@query("SC2_mid_of_row_name", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '-' || p_type WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name END AS mid FROM part""")
def sc2(t):
    k = F.col("p_partkey")
    row = F.when(k % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit("-"), "p_type", F.lit("-Genus_one\""))).when(k % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("-other")))
    return t.part.select("p_partkey", names.mid_of_row_name(row, F.lit("Genus_one")).alias("mid"))


@query("SC3_split_pair", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '-x' ELSE p_name || '-y' END AS mid, CASE WHEN p_partkey % 2 = 0 THEN 'A_b' ELSE 'Unknown' END AS src FROM part")
def sc3(t):
    row = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("-x-A_b"))).otherwise(F.concat("p_name", F.lit("-y")))
    return t.part.select("p_partkey", names.split_pair(row).alias("s")).select("p_partkey", "s.mid", "s.src")


@query("SC4_without_suffix", "SELECT p_partkey, p_name AS name FROM part")
def sc4(t):
    return t.part.select("p_partkey", names.without_suffix(F.concat("p_name", F.lit("-S.1")), "S.1").alias("name"))


@query(
    "SC5_normal_forms",
    """WITH p AS (SELECT p_partkey, ' ' || p_brand || ' ' || p_name || '-X.' AS n FROM part)
    SELECT p_partkey, replace(replace(trim(lower(n)), ' ', '_'), '-', '_') AS a, trim(replace(replace(lower(n), '_', ' '), '-', ' ')) AS b, replace(replace(lower(n), ' ', '_'), '.', '') AS c,
    trim(regexp_replace(lower(n), '[^a-z0-9]+', '_', 'g'), '_') AS d FROM p""",
)
def sc5(t):
    n = F.concat(F.lit(" "), "p_brand", F.lit(" "), "p_name", F.lit("-X."))
    return t.part.select("p_partkey", names.underscored(n).alias("a"), names.spaced(n).alias("b"), names.dotless(n).alias("c"), names.node_id(n).alias("d"))


@query(
    "SC6_salt_variants",
    """SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN ['w' || p_size || 'ate'] WHEN 1 THEN ['w' || p_size || 'ite'] WHEN 2 THEN ['w' || p_size || 'ic_acid'] ELSE ['w' || p_size || 'ous_acid'] END) AS variant FROM part""",
)
def sc6(t):
    k = F.pmod("p_partkey", F.lit(4))
    end = F.when(k == 0, "ic_acid").when(k == 1, "ous_acid").when(k == 2, "ate").otherwise("ite")
    return t.part.select("p_partkey", F.explode(names.salt_variants(F.concat(F.lit("w"), "p_size", end))).alias("variant"))


@query("SC7_lookup_variants", """WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '_' || p_name ELSE replace(p_name, ' ', '-') || '-X_y' END AS name FROM part),
    v AS (SELECT p_partkey, unnest([name, replace(name, '_', ' '), replace(name, ' ', '_'), replace(name, '-', '_')]) AS v, unnest([1, 2, 3, 4]) AS pos FROM n),
    f AS (SELECT p_partkey, arg_min(v, pos) AS v, min(pos) AS pos FROM v GROUP BY p_partkey, lower(v)) SELECT p_partkey, string_agg(v, '|' ORDER BY pos) AS variants FROM f GROUP BY p_partkey""")
def sc7(t):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws("_", "p_brand", "p_name")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-X_y")))
    return t.part.select("p_partkey", joined(names.lookup_variants(name)).alias("variants"))


@query(
    "SC8_search_term",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Genus species' WHEN p_partkey % 3 = 1 THEN p_name ELSE 'some node' END AS term FROM part""",
)
def sc8(t):
    k = F.col("p_partkey") % 3
    node = F.when(k == 0, "genus").when(k == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise("some_node")
    return t.part.select("p_partkey", names.search_term(node, F.lit("Genus_species"), F.col("p_name")).alias("term"))


@query("SC9_query_text", """SELECT p_partkey, '"' || p_name || '" AND "' || replace(p_type, '_', ' ') || '"' AS plain, '"' || p_name || '"[Title/Abstract] AND "' || p_type || '"[Title/Abstract]' AS fielded FROM part""")
def sc9(t):
    terms = F.array("p_name", F.lit("  "), "p_type")
    return t.part.select("p_partkey", names.all_of(terms).alias("plain"), names.all_of(terms, "[Title/Abstract]").alias("fielded"))


@query("SC10_query_fingerprint", """SELECT p_partkey, md5('"' || p_name || '"') AS key FROM part""")
def sc10(t):
    return t.part.select("p_partkey", names.fingerprint(names.all_of(F.array("p_name"))).alias("key"))


@query("SC15_aliases", """SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN p_name || '|' || split_part(p_name, ' ', 1) ELSE p_name END AS wide,
    CASE WHEN contains(p_name, ' ') THEN p_name || '|' || p_name[1] || '. ' || split_part(p_name, ' ', 2) || '|' || p_name[1] || '.' || split_part(p_name, ' ', 2) ELSE p_name END AS strict FROM part""")
def sc15(t):
    return t.part.select("p_partkey", joined(names.aliases(F.col("p_name"))).alias("wide"), joined(names.strict_aliases(F.col("p_name"), True)).alias("strict"))


@query("SC16_group_aliases", """WITH n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' of the ' || p_brand WHEN 2 THEN replace(p_name, ' ', '_') || '_and_X2' ELSE p_type END AS name FROM part),
    w AS (SELECT p_partkey, name, upper(list_aggregate(list_transform(list_filter(regexp_extract_all(replace(name, '_', ' '), '[A-Za-z]+|[0-9]+'), lambda x: lower(x) NOT IN ('of', 'and', 'the')), lambda x: CASE WHEN x[1] BETWEEN '0' AND '9' THEN x ELSE x[1] END), 'string_agg', '')) AS acronym FROM n),
    v AS (SELECT p_partkey, unnest([name, replace(name, '_', ' '), CASE WHEN name = 'small ring' THEN 'small ring' END, CASE WHEN name = 'small ring' THEN 'tiny band' END,
        CASE WHEN length(acronym) BETWEEN 2 AND 8 AND length(regexp_replace(acronym, '[^A-Z]', '', 'g')) >= 2 THEN acronym END]) AS v, unnest([1, 2, 3, 4, 5]) AS pos FROM w),
    f AS (SELECT p_partkey, arg_min(v, pos) AS v, min(pos) AS pos FROM v WHERE v != '' GROUP BY p_partkey, lower(v)) SELECT p_partkey, string_agg(v, '|' ORDER BY pos) AS names FROM f GROUP BY p_partkey""")
def sc16(t):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" of the ", "p_name", "p_brand")).when(k == 2, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_and_X2"))).otherwise(F.col("p_type"))
    return t.part.select("p_partkey", joined(names.group_aliases(name, {"small ring": ["small ring", "tiny band"]})).alias("names"))


KEYWORDS = "regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-/+]{2,}')"


@query(
    "SC13_keywords",
    f"""WITH w AS (SELECT item_id, unnest({KEYWORDS}) AS word, generate_subscripts({KEYWORDS}, 1) AS pos FROM benchmark),
    f AS (SELECT item_id, lower(word) AS low, arg_min(word, pos) AS word, min(pos) AS pos FROM w WHERE lower(trim(word, ' _-/+')) NOT IN ({', '.join(f"'{s}'" for s in STOP)}) GROUP BY ALL)
    SELECT item_id, string_agg(word, '|' ORDER BY pos) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS nth FROM f) WHERE nth <= 8 GROUP BY item_id""",
)
def sc13(t):
    return t.benchmark.select("item_id", joined(names.keywords(F.col("text"), STOP)).alias("keywords"))


@query(
    "SC17_distinct_in_order",
    """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM benchmark),
    f AS (SELECT item_id, arg_min(trim(word), pos) AS word, min(pos) AS pos FROM w WHERE trim(word) != '' GROUP BY item_id, lower(trim(word)))
    SELECT item_id, string_agg(word, '|' ORDER BY pos) AS words FROM f GROUP BY item_id""",
)
def sc17(t):
    return t.benchmark.select("item_id", joined(names.distinct_in_order(F.split("text", " "))).alias("words"))


@query("SC18_without_tags", r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))[:1200] AS text FROM pages""")
def sc18(t):
    return t.pages.select("page_id", texts.without_tags(F.col("html")).alias("text"))


@query("SC20_ids_of_field", "SELECT o_orderkey, list_aggregate(['1' || o_custkey, o_orderkey::VARCHAR], 'string_agg', '|') AS ids, '1' || o_custkey AS first FROM orders")
def sc20(t):
    field = F.concat(F.lit(" 1"), "o_custkey", F.lit("; "), "o_orderkey", F.lit(",,"))
    return t.orders.select("o_orderkey", joined(names.ids_of(field)).alias("ids"), names.first_number(field).alias("first"))


@query("SC28_run_ids", r"""SELECT o_orderkey, 'run_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || lower(trim(regexp_replace('Customer #' || o_custkey, '\W+', '_', 'g'), '_')[:20]) || '_' || lower(trim(regexp_replace(o_orderpriority, '\W+', '_', 'g'), '_')[:12]) AS run_id FROM orders""")
def sc28(t):
    return t.orders.select("o_orderkey", names.run_id(F.col("o_orderdate"), F.concat(F.lit("Customer #"), "o_custkey"), F.col("o_orderpriority")).alias("run_id"))


@query("SC30_score_arithmetic", "SELECT l_orderkey, l_linenumber, round(1 - ln(1 + l_quantity) / ln(51), 4) AS novelty, round(log2(1 + l_quantity), 4) AS lg, round(sqrt(l_quantity), 4) AS root FROM lineitem")
def sc30(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(1 - F.log1p(q) / F.log1p(F.lit(50.0)), 4).alias("novelty"), F.round(F.log2(1 + q), 4).alias("lg"), F.round(F.sqrt(q), 4).alias("root"))


@query("SC31_map_and_list_access", "SELECT l_orderkey, CASE WHEN bool_or(l_linenumber = 1) THEN max(l_quantity) FILTER (WHERE l_linenumber = 1) ELSE 0 END AS first_quantity, CASE WHEN count(*) > 2 THEN 2 ELSE count(*) END AS n_first FROM lineitem GROUP BY l_orderkey")
def sc31(t):
    rows = t.lineitem.groupBy("l_orderkey", F.col("l_linenumber").cast("string").alias("k")).agg(F.max("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    maps = rows.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "q"))).alias("m"), F.sum("n").alias("n"))
    return maps.select("l_orderkey", names.count_of(F.col("m"), "1").alias("first_quantity"), F.size(F.slice(F.sequence(F.lit(1).cast("long"), F.col("n")), 1, 2)).cast("long").alias("n_first"))


@query("FL4_either_way", "SELECT p_partkey, p_name FROM part WHERE contains('a small ring of steel', p_name) OR contains(p_name, 'a small ring of steel')")
def fl4(t):
    return t.part.filter(texts.has_either_way(F.lit("a small ring of steel"), F.col("p_name"))).select("p_partkey", "p_name")


@query("FL7_whole_term", r"SELECT doc_id FROM documents WHERE regexp_matches(' ' || lower(regexp_replace(text, '\s+', ' ', 'g')) || ' ', '[^a-z0-9](of\s+the|with)[^a-z0-9]')")
def fl7(t):
    return t.documents.filter(texts.mentions(F.col("text"), ["of the", "With"])).select("doc_id")


@query("FL9_any_of_terms", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'license|password|e\\.g\\.')")
def fl9(t):
    return t.documents.filter(texts.any_of(F.col("text"), ["License", "password", "e.g."])).select("doc_id")


@query(
    "WN11_sentence_windows",
    r"""WITH s AS (SELECT item_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x != '') AS parts FROM benchmark),
    w AS (SELECT item_id, list_aggregate(parts[i + 1 : i + n], 'string_agg', ' ') AS win FROM s, LATERAL (SELECT unnest(range(0, len(parts))) AS i), (SELECT unnest([1, 2]) AS n))
    SELECT item_id, count(DISTINCT lower(win)) AS n_windows, max(length(win)) AS longest FROM w GROUP BY item_id""",
)
def wn11(t):
    w = t.benchmark.select("item_id", F.explode(texts.windows(F.col("text"))).alias("window"))
    return w.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max(F.length("window")).cast("long").alias("longest"))
