"""Queries of article grading, gates, audits and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import articles, audits, gates
from ..sources import files
from ..sources.shared import shared_path
from .registry import Tables, query

@query("TK10_best_protocols", """WITH s AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, 2 * (contains(lower(url), 'blog') OR contains(lower(html), 'blog'))::INT + 2 * coalesce(contains(lower(html), 'the'), false)::INT + (page_id % 3 = 0)::INT + 2 * contains(url, 'https')::INT AS score FROM pages)
    SELECT host, page_id, score FROM s QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) <= 3""")
def tk10(t):
    score = articles.protocol_score(F.col("url"), F.col("html"), F.when(F.col("page_id") % 3 == 0, "10.1/x"), F.contains("url", F.lit("https")), ["blog", "the"])
    rows = t.pages.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "page_id", score.alias("score"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("score"), "page_id"))).filter("n <= 3").drop("n")


@query("TX12_capped_lists", """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM benchmark),
    f AS (SELECT item_id, arg_min(trim(word), pos) AS word, min(pos) AS pos FROM w WHERE trim(word) != '' GROUP BY item_id, lower(trim(word)))
    SELECT item_id, string_agg(word, '|' ORDER BY pos) AS words FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 12) GROUP BY item_id""")
def tx12(t):
    return t.benchmark.select("item_id", F.array_join(articles.capped(F.split("text", " ")), "|").alias("words"))


#: SQL of the first items of each conversation: a turn's trimmed text and role, null roles every third turn, bare texts instead of objects every seventh.
TURNS = """tu AS (SELECT conv_id, turn, CASE WHEN turn % 3 != 0 THEN role END AS role, coalesce(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') AS text,
    'c' || conv_id || '|' || turn AS ids, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS nth FROM conversations),
it AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY nth) AS pos FROM tu WHERE turn % 7 != 5)"""


def turn_items(t: Tables) -> DataFrame:
    """A list in JSON per conversation, with the fields of every kind of list in each turn's object."""
    turn, role, text = F.col("turn"), F.when(F.col("turn") % 3 != 0, F.col("role")), F.col("text")
    padded = F.concat(F.lit("\n "), F.coalesce(text, F.lit("")), F.lit("  "))
    ids = F.array(F.concat(F.lit(" c"), "conv_id"), F.lit(" "), turn.cast("string"))
    fields = {
        "claim": padded, "support_level": F.upper(role), "pmids": ids, "reason": turn, "claim_type": role, "model_type": F.lit(""), "evidence_summary": padded, "initial_claim": padded, "self_critique": role, "evidence_checked": ids, "revision": F.lit(False),
        "remaining_uncertainty": F.lit(" none "), "round": turn.cast("string"), "label": role, "query": padded, "rationale": F.lit(0), "pmid_count": turn + 0.75, "article_count": F.lit("many"), "topic": padded, "evidence_type": role, "representative_pmids": ids,
    }
    item = F.when(turn % 7 == 5, F.lit('"no object"')).otherwise(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))
    rows = t.conversations.select("conv_id", F.struct("turn", "role", "text", item.alias("item")).alias("x"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return rows.select("conv_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["item"]), ","), F.lit("]")).alias("json"))


def fields_of(items: DataFrame, key: str) -> DataFrame:
    """(key, pos, fields): the items of an array of structs with their fields in one text."""
    names = items.schema["items"].dataType.elementType.names
    part = lambda n: F.concat_ws("|", "x." + n) if items.schema["items"].dataType.elementType[n].dataType.typeName() == "array" else F.col("x." + n).cast("string")
    return items.select(key, F.posexplode("items").alias("pos", "x")).select(key, F.col("pos").cast("long") + 1, F.concat_ws("/", *map(part, names))).toDF(key, "pos", "fields")


def register_lists() -> None:
    level, role = "coalesce(lower(role), 'speculative')", "coalesce(role, 'unspecified')"
    shown = {
        "claims": f"text || '/' || {level} || '/' || ids || '/' || CASE turn WHEN 0 THEN '' ELSE turn::VARCHAR END",
        "evidence": f"{role} || '/' || text || '/' || {level} || '/' || ids || '/unspecified/' || text",
        "reflections": "text || '/' || coalesce(role, '') || '/' || ids || '//none'",
        "queries": "turn || '/' || coalesce(role, '') || '/' || text || '//' || turn || '/0'",
        "strengths": f"text || '/' || {level} || '/' || {role} || '//' || ids",
    }
    for kind, sql in shown.items():
        whole = f"WITH {TURNS} SELECT conv_id, pos, {sql} AS fields FROM it WHERE nth <= {audits.LIMITS[kind]}"

        @query(f"TX12_{kind}", whole)
        def normal(t, kind=kind):
            return fields_of(turn_items(t).select("conv_id", audits.normal_items(F.col("json"), kind, kind == "claims").alias("items")), "conv_id")


register_lists()


@query("TX12_protocol_audit", f"""WITH {TURNS} SELECT conv_id, 'c' || conv_id AS assessment, count(*) FILTER (WHERE pos IS NOT NULL) AS supported, string_agg(CASE turn WHEN 0 THEN '' ELSE turn::VARCHAR END, '|' ORDER BY nth) FILTER (WHERE pos IS NOT NULL) AS reasons, 0 AS overstated, 'gap' AS gaps
    FROM tu LEFT JOIN (SELECT conv_id, nth, pos FROM it) USING (conv_id, nth) WHERE nth <= 12 GROUP BY conv_id""")
def tx12_audit(t):
    name = F.concat(F.lit('{"overall_assessment": " c'), "conv_id", F.lit('", "supported_claims": '), "json", F.lit(', "inference_only_claims": '), "json", F.lit(', "unsupported_or_overstated_claims": "none", "priority_gaps": [" gap ", "", null]}'))
    a = turn_items(t).select("conv_id", audits.normal_audit(name).alias("a")).select("conv_id", "a.*")
    reasons = F.array_join(F.transform("inference_only_claims", lambda x: x["reason"]), "|")
    return a.select("conv_id", F.col("overall_assessment").alias("assessment"), F.size("supported_claims").cast("long").alias("supported"), F.when(F.size("inference_only_claims") > 0, reasons).alias("reasons"), F.size("unsupported_or_overstated_claims").alias("overstated"), F.array_join("priority_gaps", "|").alias("gaps"))


@query("AG28_longest_claims", "SELECT o_custkey, arg_min(o_orderpriority || ' https://x/' || o_orderkey, (-length(o_orderpriority || ' https://x/' || o_orderkey), o_orderkey)) AS claim FROM orders GROUP BY o_custkey, o_orderpriority")
def ag28(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.concat("o_orderpriority", F.lit(" https://x/"), "o_orderkey").alias("text"))
    return articles.longest_claims(rows, "o_custkey", "text", "o_orderkey").select("o_custkey", "claim")


@query("JN15_open_gaps", "SELECT o_custkey, o_orderpriority AS gap FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders c WHERE c.o_custkey = o.o_custkey AND c.o_orderpriority = o.o_orderpriority AND c.o_orderstatus = 'F') GROUP BY ALL")
def jn15(t):
    gaps = t.orders.select("o_custkey", F.col("o_orderpriority").alias("gap")).distinct()
    return articles.open_gaps(gaps, t.orders.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderpriority").alias("claim")), "o_custkey")


@query("AG29_one_module_per_role", "SELECT o_custkey, o_orderpriority, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1, 2")
def ag29(t):
    return gates.one_per_role(t.orders, ["o_custkey"], "o_orderpriority", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("WN10_unique_module_ids", "SELECT o_orderkey, CASE WHEN n = 1 THEN o_orderpriority ELSE o_orderpriority || '.' || n END AS module_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)")
def wn10(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("module_id"))
    return gates.unique_ids(rows, ["o_custkey"], "module_id", "o_orderkey").select("o_orderkey", "module_id")


@query("AG30_provenance_audit", "SELECT l_orderkey, count(*) AS n, count_if(l_returnflag != 'A') AS n_issues, CASE WHEN count_if(l_returnflag != 'A') = 0 THEN 'complete' WHEN count_if(l_returnflag != 'A') < count(*) THEN 'partial' ELSE 'incomplete' END AS status FROM lineitem GROUP BY l_orderkey")
def ag30(t):
    flag = F.col("l_returnflag")
    rows = t.lineitem.select("l_orderkey", F.when(flag != "N", "5 mg").alias("value"), F.when(flag == "R", "literature").otherwise("user").alias("source"), F.array().cast("array<string>").alias("ids"))
    return gates.provenance_audit(rows, "l_orderkey", "value", "source", "ids")


def turns(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns of a conversation as modules: each depends on the one before; a turn's text length decides its result."""
    result = F.when(F.length("text") % 5 == 0, "failed").otherwise("positive")
    m = t.conversations.select(F.col("conv_id").alias("plan"), F.col("turn").cast("string").alias("module_id"), result.alias("result_status"), F.lit("ready").alias("design_status"), F.lit("all_of").alias("operator"))
    c = t.conversations.filter("turn > 0").select(F.col("conv_id").alias("plan"), F.col("turn").cast("string").alias("module_id"), (F.col("turn") - 1).cast("string").alias("needs"), F.lit(None).cast("string").alias("gate"), F.array(F.lit("positive")).alias("accepted"))
    return m.dropDuplicates(["plan", "module_id"]), c.dropDuplicates(["plan", "module_id"]), m.select("plan", F.lit("none").alias("gate"), F.lit("positive").alias("result_status")).distinct()


GATES = """m AS (SELECT conv_id, turn, coalesce(length(text) % 5 = 0, false) AS bad FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN coalesce(bool_or(bad) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'unmet' ELSE 'met' END AS gate_status FROM m)"""


@query("TX14_activation_gates", f"WITH {GATES} SELECT gate_status, count(*) AS n FROM g GROUP BY gate_status")
def tx14(t):
    return gates.evaluated(*turns(t)).groupBy("gate_status").agg(F.count(F.lit(1)).alias("n"))


@query("TX15_execution_status", f"WITH {GATES} SELECT conv_id AS plan, turn::VARCHAR AS module_id, CASE gate_status WHEN 'met' THEN 'ready_now' ELSE 'conditional_future' END AS status FROM g")
def tx15(t):
    g = gates.evaluated(*turns(t)).withColumn("design_status", F.lit("execution_complete"))
    return g.select("plan", "module_id", gates.execution_status().alias("status"))


# files: written from the tables to the shared folder and read back


def folder(t: Tables, name: str) -> str:
    return shared_path(t.spark, name)


PAIRS = "SELECT 'S' || s_nationkey || '_x' AS src, 'P' || l_partkey AS mid, max(l_extendedprice) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"


def coordinate_files(t: Tables, row_name: str = "Row.names") -> str:
    """A folder with the coordinates of one source per subfolder, under the given name of the column with the row names."""
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    src = F.concat(F.lit("S"), "s_nationkey", F.lit("_x"))
    rows = rows.groupBy(src.alias("src"), F.concat(F.lit("P"), "l_partkey").alias("mid")).agg(F.max("l_extendedprice").alias("Pseudotime"))
    rows = rows.select(F.lit("x").alias("_c0"), F.concat_ws("-", "mid", "src").alias(row_name), "Pseudotime", F.concat(F.lit("a_min0_"), "src", F.lit("_seed_1")).alias("run"))
    path = folder(t, "coordinates")
    rows.hint("rebalance", "run").write.partitionBy("run").option("header", True).csv(path)  # a large source is several files, each of another task
    return path


@query("IO2_coordinate_files", PAIRS)
def io2(t):
    return files.coordinates(t.spark, coordinate_files(t)).select("src", "mid", "value")


@query("IO1_strict_coordinate_files", PAIRS)
def io1(t):
    return files.coordinates(t.spark, coordinate_files(t), strict=True).select("src", "mid", "value")


@query("IO3_files_by_name", f"SELECT * FROM ({PAIRS}) WHERE src LIKE 'S1%'")
def io3(t):
    return files.coordinates(t.spark, coordinate_files(t), name_part="_min0_S1").select("src", "mid", "value")


@query("IO4_row_names_in_second_column", PAIRS)
def io4(t):
    return files.coordinates(t.spark, coordinate_files(t, row_name="id")).select("src", "mid", "value")


@query("ST1_rows_of_many_files", f"SELECT src, count(*) AS n_rows, max(value) AS most FROM ({PAIRS}) GROUP BY src")
def st1(t):
    rows = files.coordinates(t.spark, coordinate_files(t), pattern="*.csv")
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"), F.max("value").alias("most"))


@query("IO10_reference_csv", "SELECT p_partkey::VARCHAR AS p_partkey, lower(trim(p_type)) AS normal_type, p_type AS raw_type FROM part")
def io10(t):
    path = folder(t, "reference")
    t.part.select("p_partkey", "p_type", "p_name").write.option("header", True).csv(path)
    columns = ["p_partkey", "p_type"]
    normal = files.reference(t.spark, path, columns, sep=",").withColumnRenamed("p_type", "normal_type")
    return normal.join(files.reference(t.spark, path, columns, sep=",", normal=False).withColumnRenamed("p_type", "raw_type"), "p_partkey")


@query("IO5_matrix", "SELECT 'P' || l_partkey AS feature, f AS sample, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = f), 0)::DOUBLE AS value FROM lineitem CROSS JOIN (VALUES ('A'), ('N'), ('R')) v(f) GROUP BY ALL")
def io5(t):
    path = folder(t, "matrix")
    table = t.lineitem.groupBy(F.concat(F.lit("P"), "l_partkey").alias("name")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity")).na.fill(0)
    table.write.option("header", True).option("sep", "\t").csv(path)
    return files.matrix(t.spark, path)


@query("IO7_IO8_gml_round_trip", "SELECT 'P' || p_partkey AS source, p_brand AS target, 'of ' || p_type AS relation FROM part")
def io7(t):
    part, brand = F.concat(F.lit("P"), "p_partkey"), F.col("p_brand")
    nodes = t.part.select(part.alias("id"), F.lit("").alias("label"), F.lit("part").alias("type")).unionByName(t.part.select(brand.alias("id"), F.lit("").alias("label"), F.lit("brand").alias("type")).distinct())
    edges = t.part.select(part.alias("source"), brand.alias("target"), F.concat(F.lit("of "), "p_type").alias("relation"))
    path = folder(t, "graph")
    files.write_gml(nodes, edges, path)
    return files.gml(t.spark, path)[1]


@query("IO11_IO17_stage_partitions", "SELECT o_orderpriority AS run_id, count(*) AS n FROM orders GROUP BY 1")
def io11(t):
    path = folder(t, "stage")
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("run_id"))
    files.write_stage(rows, path)
    files.write_stage(rows.filter("run_id = '5-LOW'"), path)  # a run that is written again replaces itself only
    return t.spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("IO13_csv_tables", "SELECT p_partkey, p_name FROM part")
def io13(t):
    path = folder(t, "csv")
    files.write_csv(t.part.select("p_partkey", "p_name"), path)
    return t.spark.read.schema("p_partkey long, p_name string").option("header", True).csv(path)


@query("IO14_passages", """SELECT doc_id, pos, section, md5(text) AS text_md5 FROM (SELECT doc_id, 0 AS pos, 'METHODS|p' AS section, text FROM documents
    UNION ALL SELECT doc_id, 1, 'TITLE|front|' || coalesce(source, ''), coalesce(lang, '') || ': ' || coalesce(text, '') FROM documents) WHERE regexp_matches(text, '\\S')""")
def io14(t):
    infons = F.create_map(F.lit("section_type"), F.lit("METHODS"), F.lit("type"), F.lit("p"))
    front = F.create_map(F.lit("section_type"), F.lit("TITLE"), F.lit("type"), F.lit("front"), F.lit("title"), F.coalesce("source", F.lit("")))
    said = F.concat(F.coalesce("lang", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    both = [F.struct(F.array(F.struct(i.alias("infons"), x.alias("text"))).alias("passages")) for i, x in ((infons, F.col("text")), (front, said))]  # two documents of one passage
    body = F.to_json(F.struct(F.array(*both).alias("documents")))
    found = files.passages(t.documents.select("doc_id", body.alias("json")), "doc_id", "json")
    return found.select("doc_id", "pos", "section", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("IO18_source_paths", "SELECT 'orders.parquet' AS file, count(*) AS n FROM orders")
def io18(t):
    path = files.relative(t.sf_dir)
    rows = t.spark.read.parquet(f"{t.sf_dir}/orders.parquet").select(F.substring_index(path, "/", 1).alias("file"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("IO6_taxonomy", "SELECT p_brand AS feature, p_name AS species FROM part")
def io6(t):
    path = folder(t, "taxonomy")
    t.part.select(F.col("p_brand").alias("a"), F.col("p_name").alias("b")).write.option("header", True).option("sep", "\t").csv(path)
    return files.taxonomy(t.spark, path)


@query("SC18_shortened", "SELECT doc_id, CASE WHEN length(c) > 40 THEN rtrim(c[:39]) || '…' ELSE c END AS short FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c FROM documents)")
def sc18(t):
    return t.documents.select("doc_id", texts.shortened(F.col("text"), 40).alias("short"))
