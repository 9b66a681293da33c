"""Queries of signal, composition and quadrants over line items.

A source is a supplier, an intermediate a part, a pair's value the largest
price of their line items; abundances are quantities per part and month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compose, embed, ordered, quadrant, signal, spectral
from ..sources.shared import kept
from .registry import Tables, query


def coordinates(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("mid")).agg(F.max("l_extendedprice").alias("value"))


COORDINATES = "c AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS mid, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL)"
SIGNAL = f"""{COORDINATES},
m AS (SELECT *, max(value) OVER (PARTITION BY src) AS most, count(*) OVER (PARTITION BY src) AS n FROM c),
s AS (SELECT src, mid, value, least(value, most - value) AS distance_to_end,
             1.0 - (row_number() OVER (PARTITION BY src ORDER BY least(value, most - value), mid) - 1) / n::DOUBLE AS signal,
             row_number() OVER (PARTITION BY src ORDER BY value DESC, mid) AS rank_in_src, n AS total_in_src FROM m)"""


@query("WN1_dual_end_signal", f"WITH {SIGNAL} SELECT src, mid, round(signal, 6) AS signal, total_in_src FROM s")
def wn1(t):
    return signal.dual_end_signal(kept(coordinates(t), "coordinates")).select("src", "mid", F.round("signal", 6).alias("signal"), "total_in_src")


@query("WN2_rank_in_source", f"WITH {SIGNAL} SELECT src, mid, rank_in_src FROM s")
def wn2(t):
    return signal.rank_in_source(kept(coordinates(t), "coordinates")).select("src", "mid", "rank_in_src")


@query(
    "WN3_first_per_pair",
    """SELECT l_suppkey, l_partkey, l_extendedprice AS price, l_orderkey, l_linenumber FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) = 1""",
)
def wn3(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber")
    return signal.first_per_pair(rows, ["l_suppkey", "l_partkey"], "price", ["l_orderkey", "l_linenumber"])


@query("TK1_top_signal", f"WITH {SIGNAL} SELECT src, mid, round(value, 4) AS value, round(signal, 4) AS signal, rank_in_src, total_in_src FROM s ORDER BY s.signal DESC, src, mid LIMIT 200")
def tk1(t):
    return signal.candidates(coordinates(t))


@query(
    "AG1_group_maximum",
    f"WITH {COORDINATES} SELECT src, max(value) AS most, count(*) AS n FROM c GROUP BY src",
)
def ag1(t):
    return coordinates(t).groupBy("src").agg(F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))


@query(
    "FL1_usable_values",
    """WITH v AS (SELECT l_orderkey, l_linenumber, l_returnflag AS file, CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice END AS value FROM lineitem)
    SELECT l_orderkey, l_linenumber, value FROM (SELECT *, max(value) OVER (PARTITION BY file) AS most FROM v WHERE value IS NOT NULL) WHERE most > 0""",
)
def fl1(t):
    value = F.when(F.col("l_returnflag") == "N", 0.0).when(F.col("l_linenumber") != 1, F.col("l_extendedprice"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("file"), value.alias("value"))
    return signal.usable(rows, file="file").select("l_orderkey", "l_linenumber", "value")


@query("TK8_least_values", f"WITH {COORDINATES} SELECT src, mid, value FROM c ORDER BY value, src, mid LIMIT 50")
def tk8(t):
    return coordinates(t).orderBy("value", "src", "mid").limit(50)


def scored(t: Tables) -> DataFrame:
    """src, mid, signal, novelty and two experimental counts per pair: what the last step takes.  One aggregate gives values and counts."""
    src, mid = F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("mid")
    pairs = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(
        F.max("l_extendedprice").alias("value"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("pair_sm_exp"), F.count_if(F.col("l_linestatus") == "O").alias("pair_md_exp")
    )
    pairs = kept(pairs.select(src, mid, "value", "n", "pair_sm_exp", "pair_md_exp"), "pairs")
    most = pairs.agg(F.max("n").alias("most"))
    pairs = signal.dual_end_signal(pairs).crossJoin(F.broadcast(most))  # one row
    return pairs.withColumn("novelty", quadrant.novelty_by_batch(F.col("n"), F.col("most"))).select("src", "mid", "signal", "n", "pair_sm_exp", "pair_md_exp", "novelty")


SCORED = f"""{SIGNAL},
k AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS mid, count(*) AS n, count_if(l_returnflag = 'R') AS pair_sm_exp, count_if(l_linestatus = 'O') AS pair_md_exp FROM lineitem GROUP BY ALL),
q AS (SELECT src, mid, signal, n, pair_sm_exp, pair_md_exp, 1.0 - ln(1.0 + n) / ln(1.0 + max(n) OVER ()) AS novelty FROM s JOIN k USING (src, mid))"""
ASSIGNED = f"""{SCORED},
t AS (SELECT median(signal) AS t1, median(novelty) AS t2 FROM q),
a AS (SELECT q.*, CASE WHEN signal > t1 AND novelty >= t2 THEN 'I' WHEN novelty >= t2 THEN 'II' WHEN signal > t1 THEN 'III' ELSE 'IV' END AS quadrant,
             round(signal * (1 + log2(1.0 + pair_sm_exp)) * (1 + log2(1.0 + pair_md_exp)), 4) AS composite_score FROM q, t)"""


@query("AG12_novelty_by_batch_maximum", f"WITH {SCORED} SELECT src, mid, n, round(novelty, 6) AS novelty FROM q")
def ag12(t):
    return scored(t).select("src", "mid", "n", F.round("novelty", 6).alias("novelty"))


@query(
    "AG13_novelty_by_ceiling",
    """SELECT l_partkey, count(*) AS n, round(greatest(0.0, least(1.0, 1.0 - ln(1.0 + count(*)) / ln(51.0))), 6) AS novelty FROM lineitem GROUP BY l_partkey""",
)
def ag13(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).withColumn("novelty", F.round(quadrant.novelty_by_ceiling(F.col("n"), 50), 6))


@query("AG16_medians", f"WITH {SCORED} SELECT round(median(signal), 6) AS signal, round(median(novelty), 6) AS novelty FROM q")
def ag16(t):
    return quadrant.medians(kept(scored(t), "scored"), signal="signal", novelty="novelty").select(F.round("signal", 6).alias("signal"), F.round("novelty", 6).alias("novelty"))


@query("QD1_quadrants", f"WITH {ASSIGNED} SELECT src, mid, quadrant, quadrant = 'I' AS is_dark FROM a")
def qd1(t):
    return quadrant.assigned(scored(t)).select("src", "mid", "quadrant", "is_dark")


@query("QD2_composite_score", f"WITH {ASSIGNED} SELECT src, mid, composite_score FROM a")
def qd2(t):
    return quadrant.assigned(scored(t)).select("src", "mid", "composite_score")


@query("QD4_evidence_foundation", f"WITH {ASSIGNED} SELECT src, mid, pair_md_exp AS evidence_foundation FROM a WHERE quadrant = 'I'")
def qd4(t):
    return quadrant.assigned(scored(t)).filter("is_dark").select("src", "mid", "evidence_foundation")


@query("AG17_quadrant_summary", f"""WITH {ASSIGNED} SELECT count(*) AS n, count_if(quadrant = 'I') AS n_i, count_if(quadrant = 'II') AS n_ii, count_if(quadrant = 'III') AS n_iii,
    count_if(quadrant = 'IV') AS n_iv, count_if(quadrant = 'I') AS n_dark, round(min(novelty), 6) AS least_novelty, round(max(novelty), 6) AS most_novelty FROM a""")
def ag17(t):
    out = quadrant.summary(quadrant.assigned(scored(t)))
    return out.withColumns({c: F.round(c, 6) for c in ("least_novelty", "most_novelty")})


BY_PRIORITY = "array_position(['I', 'II', 'III', 'IV'], quadrant)"


@query("TK2_by_quadrant_and_score", f"WITH {ASSIGNED} SELECT src, mid, quadrant, composite_score FROM a ORDER BY {BY_PRIORITY}, composite_score DESC, src, mid LIMIT 300")
def tk2(t):
    return quadrant.by_priority(quadrant.assigned(scored(t)), "composite_score", "src", "mid").select("src", "mid", "quadrant", "composite_score").limit(300)


@query("TK3_by_quadrant_and_signal", f"WITH {ASSIGNED} SELECT src, mid, quadrant, round(signal, 6) AS signal FROM a ORDER BY {BY_PRIORITY}, a.signal DESC, src, mid LIMIT 300")
def tk3(t):
    return quadrant.by_priority(quadrant.assigned(scored(t)), "signal", "src", "mid").select("src", "mid", "quadrant", F.round("signal", 6).alias("signal")).limit(300)


@query("TK11_table_by_count", f"WITH {ASSIGNED} SELECT src, mid, n, quadrant FROM a WHERE quadrant IN ('I', 'III') ORDER BY n, src, mid LIMIT 100")
def tk11(t):
    return quadrant.assigned(scored(t)).filter(F.col("quadrant").isin("I", "III")).orderBy("n", "src", "mid").select("src", "mid", "n", "quadrant").limit(100)


@query("TK12_top_novel_flag", f"""WITH {ASSIGNED} SELECT src, mid, row_number() OVER (PARTITION BY quadrant ORDER BY composite_score DESC, src, mid) <= 10 AS is_top FROM a WHERE novelty < 1""")
def tk12(t):
    rows = quadrant.assigned(scored(t)).filter("novelty < 1")
    rows = ordered.among_first(rows, ["quadrant"], [F.desc("composite_score"), "src", "mid"], ["src", "mid"], 10, "is_top")
    return rows.select("src", "mid", "is_top")


@query("FL17_with_evidence", f"WITH {ASSIGNED} SELECT src, mid, pair_sm_exp + pair_md_exp AS evidence FROM a WHERE pair_sm_exp + pair_md_exp > 0 AND novelty < 1")
def fl17(t):
    return scored(t).withColumn("evidence", F.col("pair_sm_exp") + F.col("pair_md_exp")).filter("evidence > 0 AND novelty < 1").select("src", "mid", "evidence")


@query("QD3_detected_target", "SELECT l_orderkey, l_linenumber, (SELECT arg_min(l_returnflag, (l_orderkey, l_linenumber)) FROM lineitem) AS target FROM lineitem")
def qd3(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("target")).withColumn("at", F.struct("l_orderkey", "l_linenumber"))
    return quadrant.detected(rows, "target", "none", "at").drop("at")


# compositions


def abundance(t: Tables, flag: str | None = None) -> DataFrame:
    """Quantities per part and month; with ``flag`` zero where no line item has it."""
    value = F.col("l_quantity") if flag is None else F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0)
    return t.lineitem.groupBy(F.concat(F.lit("P"), "l_partkey").alias("feature"), F.date_format("l_shipdate", "yyyy-MM").alias("sample")).agg(F.sum(value).alias("value"))


def totals(t: Tables) -> DataFrame:
    """Account balances per supplier and month, with negative ones: the other kind of matrix."""
    rows = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("feature"), F.date_format("l_shipdate", "yyyy-MM").alias("sample")).agg(F.max("s_acctbal").alias("value"))


ABUNDANCE = """b AS (SELECT 'P' || l_partkey AS feature, strftime(l_shipdate, '%Y-%m') AS sample, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS value FROM lineitem GROUP BY ALL),
p AS (SELECT feature, sample, CASE WHEN value = 0 THEN (SELECT min(value) FROM b WHERE value != 0) ELSE value END AS value FROM b)"""
CLR = f"{ABUNDANCE}, r AS (SELECT feature, sample, ln(value) - avg(ln(value)) OVER (PARTITION BY sample) AS clr FROM p)"
SHIFTED = """b2 AS (SELECT 'S' || l_suppkey AS feature, strftime(l_shipdate, '%Y-%m') AS sample, max(s_acctbal) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
p2 AS (SELECT feature, sample, CASE WHEN (SELECT min(value) FROM b2) <= 0 THEN value - (SELECT min(value) FROM b2) + 1e-6 ELSE value END AS value FROM b2),
r2 AS (SELECT feature, sample, ln(value) - avg(ln(value)) OVER (PARTITION BY sample) AS clr FROM p2)"""


@query("AG3_zero_replacement", f"WITH {ABUNDANCE} SELECT feature, sample, value FROM p")
def ag3(t):
    return compose.made_positive(abundance(t, "A"))


@query("AG2_clr", f"WITH {CLR} SELECT feature, sample, round(clr, 6) AS clr FROM r")
def ag2(t):
    return compose.clr(abundance(t, "A")).select("feature", "sample", F.round("clr", 6).alias("clr"))


@query("TR1_clr_with_shift", f"WITH {SHIFTED} SELECT feature, sample, round(clr, 5) AS clr FROM r2")
def tr1(t):
    return compose.clr(totals(t), shift=True).select("feature", "sample", F.round("clr", 5).alias("clr"))


@query("AG4_feature_means", f"WITH {CLR} SELECT feature, round(avg(clr), 6) AS mean FROM r GROUP BY feature")
def ag4(t):
    return compose.feature_means(compose.clr(abundance(t, "A"))).select("feature", F.round("mean", 6).alias("mean"))


def correlations(t: Tables) -> DataFrame:
    """(src, mid, cor, pval): stand-ins for correlations, from discounts and taxes."""
    return t.lineitem.groupBy(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("mid")).agg((F.max("l_discount") - 0.05).alias("cor"), F.min("l_tax").alias("pval"))


CORRELATIONS = "k AS (SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS mid, max(l_discount) - 0.05 AS cor, min(l_tax) AS pval FROM lineitem GROUP BY ALL)"


@query("FL2_root_filter", f"WITH {CORRELATIONS} SELECT src, mid, round(cor, 6) AS cor, pval FROM k WHERE cor > 0 AND pval < 0.05")
def fl2(t):
    return compose.correlated(correlations(t)).withColumn("cor", F.round("cor", 6))


ROOTS = f"""{CLR}, {CORRELATIONS}, f AS (SELECT feature AS mid, round(avg(clr), 9) AS mean FROM r GROUP BY feature),
o AS (SELECT src, mid, cor, pval, mean, row_number() OVER (PARTITION BY src ORDER BY mean DESC, mid) AS nth FROM k JOIN f USING (mid) WHERE cor > 0 AND pval < 0.05),
w AS (SELECT src, mid, rank_limit, mean FROM o, (SELECT unnest([1, 2, 3, 5])::INT AS rank_limit) WHERE nth <= rank_limit)"""


def some_roots(t: Tables) -> DataFrame:
    means = compose.feature_means(compose.clr(abundance(t, "A"))).withColumn("mean", F.round("mean", 9))
    return compose.roots(correlations(t), means)


@query("WN4_nested_roots", f"WITH {ROOTS} SELECT src, mid, rank_limit, round(mean, 6) AS mean FROM w")
def wn4(t):
    return some_roots(t).select("src", "mid", "rank_limit", F.round("mean", 6).alias("mean"))


@query("JN7_means_with_correlations", f"WITH {ROOTS} SELECT src, mid, round(cor, 6) AS cor, pval, round(mean, 6) AS mean FROM k JOIN f USING (mid)")
def jn7(t):
    means = compose.feature_means(compose.clr(abundance(t, "A"))).withColumn("mean", F.round("mean", 9))
    return correlations(t).join(means.withColumnRenamed("feature", "mid"), "mid").select("src", "mid", F.round("cor", 6).alias("cor"), "pval", F.round("mean", 6).alias("mean"))


@query("AG5_root_frequencies", f"WITH {ROOTS} SELECT rank_limit, count(*) AS n, count(DISTINCT mid) AS n_roots FROM w GROUP BY rank_limit")
def ag5(t):
    return some_roots(t).groupBy("rank_limit").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("mid").alias("n_roots"))


BRANDS = """bb AS (SELECT p_brand AS feature, strftime(l_shipdate, '%Y-%m') AS sample, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
rb AS (SELECT feature, sample, ln(value) - avg(ln(value)) OVER (PARTITION BY sample) AS clr FROM bb),
bn AS (SELECT n_name AS feature, strftime(l_shipdate, '%Y-%m') AS sample, sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
rn AS (SELECT feature, sample, ln(value) - avg(ln(value)) OVER (PARTITION BY sample) AS clr FROM bn)"""
INTERACTIONS = f"{BRANDS}, x AS (SELECT sample, rb.feature || '-' || rn.feature AS pair, rb.clr * rn.clr AS score FROM rb JOIN rn USING (sample))"


def some_interactions(t: Tables) -> DataFrame:
    """Brands against nations, by month."""
    month = F.date_format("l_shipdate", "yyyy-MM").alias("sample")
    brands = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("feature"), month).agg(F.sum("l_quantity").alias("value"))
    nations = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    nations = t.lineitem.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("n_name").alias("feature"), month).agg(F.sum("l_quantity").alias("value"))
    return compose.interactions(compose.clr(brands), compose.clr(nations))


@query("JN8_interactions", f"WITH {INTERACTIONS} SELECT sample, pair, round(score, 4) AS score FROM x")
def jn8(t):
    return some_interactions(t).withColumn("score", F.round("score", 4))


@query("FL16_nonzero_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) != 0)")
def fl16(t):
    rows = t.lineitem.withColumn("score", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
    return compose.nonzero_columns(rows, "l_orderkey").select("l_orderkey", "l_linenumber")


@query(
    "JN9_targets_present",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RING|bolt') AND p_partkey IN (SELECT l_partkey FROM lineitem)",
)
def jn9(t):
    from ..functions.names import any_pattern

    return t.part.filter(any_pattern(F.col("p_name"), ["RING", "bolt"])).join(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("FL3_pattern_match", "SELECT p_partkey, p_brand FROM part WHERE regexp_matches(p_brand, '(?i)brand#1|brand#23')")
def fl3(t):
    from ..functions.names import any_pattern

    return t.part.filter(any_pattern(F.col("p_brand"), ["brand#1", "brand#23"])).select("p_partkey", "p_brand")


@query(
    "JN14_resolved_roots",
    f"WITH {ROOTS} SELECT DISTINCT rank_limit, mid FROM w WHERE mid IN (SELECT 'P' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)",
)
def jn14(t):
    present = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 45").select(F.concat(F.lit("P"), "l_partkey").alias("mid"))
    found, _ = compose.resolved_roots(some_roots(t).select("rank_limit", "mid").distinct(), present)
    return found


@query(
    "JN13_parameter_grid",
    """WITH s AS (SELECT DISTINCT 'S' || l_suppkey AS src FROM lineitem),
    g AS (SELECT n, d, k, m, z FROM unnest([2, 3, 5, 8, 10, 15, 20]) AS a(n), unnest([2, 3, 5, 10, 15, 20]) AS b(d), unnest([0.1, 0.5, 1.0]) AS c(k), unnest(['cosine', 'euclidean']) AS e(m), unnest([0.1, 0.5]) AS f(z))
    SELECT src, m AS metric, count(*) AS n, count(DISTINCT (n, d, k, m, z)) AS n_distinct FROM s, g GROUP BY ALL""",
)
def jn13(t):
    sources = t.lineitem.select(F.concat(F.lit("S"), "l_suppkey").alias("src")).distinct()
    grid = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(compose.GRID, values)]) for values in _product()])
    return compose.tasks_by_metric(sources.withColumn("tasks", grid), "src")


def _product():
    from itertools import product

    return product(*compose.GRID.values())


@query(
    "JN12_tasks_to_do",
    """WITH tasks AS (SELECT o_orderkey AS tag FROM orders), log AS (SELECT o_orderkey AS tag, CASE WHEN o_orderstatus = 'F' THEN 'OK' ELSE 'FAIL' END AS status FROM orders),
    outs AS (SELECT l_orderkey AS tag, l_linenumber AS output FROM lineitem)
    SELECT tag FROM tasks WHERE NOT (tag IN (SELECT tag FROM log WHERE status = 'OK') AND tag IN (SELECT tag FROM outs GROUP BY tag HAVING count(DISTINCT output) >= 3))""",
)
def jn12(t):
    tasks = t.orders.select(F.col("o_orderkey").alias("tag"))
    log = t.orders.select(F.col("o_orderkey").alias("tag"), F.when(F.col("o_orderstatus") == "F", "OK").otherwise("FAIL").alias("status"))
    return compose.to_do(tasks, log, t.lineitem.select(F.col("l_orderkey").alias("tag"), F.col("l_linenumber").alias("output")), 3)


@query(
    "TR5_run_summary",
    """SELECT o_orderpriority AS task, count(*) AS n, count_if(o_orderstatus = 'F') AS n_ok, count_if(o_orderstatus = 'O') AS n_skip, count_if(o_orderstatus = 'P' AND o_orderkey % 5 = 0) AS n_fail,
    count_if(o_orderstatus = 'P' AND o_orderkey % 5 = 0) > 0 AS failed FROM orders GROUP BY o_orderpriority""",
)
def tr5(t):
    status = F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "SKIP").when(F.col("o_orderkey") % 5 == 0, "FAIL").otherwise("RUN")
    return compose.run_summary(t.orders.select(F.col("o_orderpriority").alias("task"), status.alias("status")))


@query(
    "ST6_wide_pivot",
    """SELECT strftime(l_shipdate, '%Y-%m') AS sample, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'A'), 0) AS "A", coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS "N",
    coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0) AS "R" FROM lineitem GROUP BY sample""",
)
def st6(t):
    rows = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("sample"), "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return compose.wide(rows, "sample", "l_returnflag", "q", ["A", "N", "R"])


@query(
    "ST7_long_unpivot",
    """SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem""",
)
def st7(t):
    return compose.long(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_orderkey", "l_linenumber"], "variable", "value")


@query("TR2_interaction_totals", f"WITH {INTERACTIONS} SELECT pair, count(*) AS n, round(sum(score), 4) AS total FROM x GROUP BY pair")
def tr2(t):
    return some_interactions(t).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


def by_year(t: Tables) -> tuple[DataFrame, list[str]]:
    rows = some_interactions(t).withColumn("year", F.substring("sample", 1, 4)).groupBy("pair", "year").agg(F.sum("score").alias("score"))
    rows = kept(rows, "by-year")
    return rows, [r["year"] for r in rows.select("year").distinct().orderBy("year").collect()]  # a handful of columns


@query("TR3_principal_components")
def tr3(t):
    rows, years = by_year(t)
    return compose.principal_components(rows, 2, "pair", "year", "score", years)


@query("TR3_total_variance", f"""WITH {INTERACTIONS}, y AS (SELECT pair, substr(sample, 1, 4) AS year, sum(score) AS v FROM x GROUP BY ALL), n AS (SELECT count(DISTINCT pair) AS n FROM y)
    SELECT round(sum(var), 3) AS variance FROM (SELECT year, (sum(v * v) - sum(v) * sum(v) / max(n)) / (max(n) - 1) AS var FROM y, n GROUP BY year)""")
def tr3_variance(t):
    rows, years = by_year(t)
    pc = compose.principal_components(rows, len(years), "pair", "year", "score", years)
    of = pc.select(F.posexplode("pc").alias("at", "v")).groupBy("at").agg(F.var_samp("v").alias("var"))
    return of.agg(F.round(F.sum("var"), 3).alias("variance"))


def leading_sql(entries: str, shown: str, squarings: int = 14) -> str:
    """SQL of each row's place on the first component, without sign: the rows' centred products, squared until one direction is left."""
    steps = [f"k{i + 1} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) / (SELECT sum(v * v) FROM k{i}) AS v FROM k{i} a JOIN k{i} b ON a.j = b.i GROUP BY ALL)" for i in range(squarings)]
    return f"""WITH {entries}, n AS (SELECT count(DISTINCT r) AS n FROM e), me AS (SELECT c, sum(x) / max(n) AS m FROM e, n GROUP BY c), d AS (SELECT r, sum(x * m) AS d FROM e JOIN me USING (c) GROUP BY r),
    g AS (SELECT a.r AS i, b.r AS j, sum(a.x * b.x) AS g FROM e a JOIN e b USING (c) GROUP BY ALL),
    k0 AS MATERIALIZED (SELECT a.r AS i, b.r AS j, coalesce(g, 0) - a.d - b.d + (SELECT sum(m * m) FROM me) AS v FROM d a CROSS JOIN d b LEFT JOIN g ON g.i = a.r AND g.j = b.r),
    {", ".join(steps)}, t AS (SELECT sum(v) AS t FROM k{squarings} WHERE i = j), l AS (SELECT sum(a.v * b.v) / max(t) AS l FROM k0 a JOIN k{squarings} b ON a.i = b.j AND a.j = b.i, t)
    SELECT k.i AS {shown}, round(sqrt(greatest(k.v, 0) / t * l), 3) AS place, round(l / (SELECT sum(v) FROM k0 WHERE i = j), 6) AS share FROM k{squarings} k, t, l WHERE k.i = k.j"""


def leading(found: spectral.Components, row: str) -> DataFrame:
    return found.scores.select(row, F.round(F.abs(F.get("pc", F.lit(0))), 3).alias("place"), F.lit(round(found.variances[0] / found.total, 6)).alias("share"))


@query("TR3_leading_component", leading_sql(f"{INTERACTIONS}, e AS (SELECT sample AS r, pair AS c, score AS x FROM x)", "sample"))
def tr3_leading(t):
    return leading(spectral.components(some_interactions(t), 2, "sample", "pair", most_error=1e-9), "sample")


@query("TR3_wide_components", leading_sql("e AS (SELECT l_suppkey AS r, l_partkey AS c, sum(l_quantity) AS x FROM lineitem GROUP BY ALL)", "l_suppkey"))
def tr3_wide(t):
    return leading(spectral.components(t.lineitem, 2, "l_suppkey", "l_partkey", "l_quantity", most_error=1e-9), "l_suppkey")


@query(
    "TR4_ordering",
    """WITH RECURSIVE e AS (SELECT 'R' || n_regionkey AS a, 'N' || n_nationkey AS b, 1.0::DOUBLE AS length FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 0.5 FROM supplier),
    r AS (SELECT 'R' || r_regionkey AS id, 0.0::DOUBLE AS distance FROM region UNION ALL SELECT b, distance + length FROM r JOIN e ON a = id)
    SELECT id, min(distance) AS distance FROM r GROUP BY id""",
)
def tr4(t):
    e = t.nation.select(F.concat(F.lit("R"), "n_regionkey").alias("a"), F.concat(F.lit("N"), "n_nationkey").alias("b"), F.lit(1.0).alias("length"))
    e = e.unionByName(t.supplier.select(F.concat(F.lit("N"), "s_nationkey").alias("a"), F.concat(F.lit("S"), "s_suppkey").alias("b"), F.lit(0.5).alias("length")))
    return compose.ordering(e, t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("id")))


POINTS = """po AS (SELECT c_custkey AS id, c_mktsegment AS type, c_acctbal / 100 AS x, c_nationkey * 7.0::DOUBLE AS y FROM customer),
ne AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS length, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) AS nth FROM po a JOIN po b ON a.type = b.type AND a.id != b.id)"""


def points(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.array(F.col("c_acctbal") / 100, F.col("c_nationkey") * 7.0).alias("vector"))


@query("TR4_neighbour_graph", f"WITH {POINTS} SELECT a, b, round(length, 6) AS length FROM ne WHERE nth <= 5")
def tr4_graph(t):
    return embed.neighbour_graph(points(t), 5).select("a", "b", F.round("length", 6).alias("length"))


@query(
    "TR4_graph_ordering",
    f"""WITH RECURSIVE {POINTS}, e AS MATERIALIZED (SELECT a, b, length FROM ne WHERE nth <= 5 UNION SELECT b, a, length FROM ne WHERE nth <= 5),
    r(id, distance) USING KEY (id) AS (SELECT min(id), 0.0::DOUBLE FROM po GROUP BY type UNION
      SELECT e.b, min(r.distance + e.length) FROM r JOIN e ON r.id = e.a LEFT JOIN recurring.r old ON old.id = e.b WHERE old.distance IS NULL OR r.distance + e.length < old.distance - 1e-12 GROUP BY e.b)
    SELECT id, round(distance, 5) AS distance FROM r""",
)
def tr4_distances(t):
    graph = embed.neighbour_graph(points(t), 5)
    roots = points(t).groupBy("type").agg(F.min("id").alias("id")).select("id")
    return compose.ordering(graph, roots).select("id", F.round("distance", 5).alias("distance"))


@query("JN8_sample_guard", "SELECT strftime(l_shipdate, '%Y-%m') AS sample FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag != 'A')")
def jn8_guard(t):
    month = F.date_format("l_shipdate", "yyyy-MM").alias("sample")
    return compose.unmatched_samples(t.lineitem.select(month), t.lineitem.filter("l_returnflag = 'A'").select(month))

