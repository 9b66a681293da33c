"""Queries that compare methods: five scores of a document as predictors of its quality label, cut at 100 points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import benchstat
from .registry import Tables, query

METHODS = ["ranked-back", "ranked-noback", "capitals", "digits", "phi Clr"]


def metrics(t: Tables) -> DataFrame:
    """Files, X 1..100 and confusion counts: a document counts as positive at X if its score's bucket is X or more."""
    docs = t.labels.join(t.documents.select("doc_id", "text", "n_chars"), "doc_id")
    n = F.greatest(F.char_length("text"), F.lit(1))
    rate = lambda pattern: 100 * F.regexp_count("text", F.lit(pattern)) / n
    scores = [F.least("n_chars", F.lit(5000)) / 50, F.least(F.regexp_count("text", F.lit("[^ ]+")), F.lit(1000)) / 10, 100 - rate("[A-Z]"), 100 - rate("[^a-z ]"), rate("[aeiou]")]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("Files"), F.greatest(F.lit(1), F.least(F.lit(100), F.ceil(s))).cast("int").alias("bucket")) for m, s in zip(METHODS, scores)]))
    rows = docs.select("quality", each.alias("s")).select("quality", "s.*")
    counts = rows.groupBy("Files", "bucket").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") == 0).alias("neg"))
    every = t.spark.createDataFrame([(m,) for m in METHODS], "Files string").withColumn("X", F.explode(F.sequence(F.lit(1), F.lit(100))))
    counts = every.join(counts, (every["Files"] == counts["Files"]) & (every["X"] == counts["bucket"]), "left").select(every["Files"], "X", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    up = Window.partitionBy("Files").orderBy(F.desc("X"))
    below = Window.partitionBy("Files").orderBy("X").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select(
        "Files", "X", F.sum("pos").over(up).alias("TP"), F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("TN"), F.sum("neg").over(up).alias("FP"), F.coalesce(F.sum("pos").over(below), F.lit(0)).alias("FN")
    )
    return sums.withColumns({c: x for c, x in benchstat.recomputed().items()})


def prepared(t: Tables) -> DataFrame:
    return benchstat.derived(benchstat.cleaned(metrics(t)))


METRICS = """d AS (SELECT quality, text, n_chars, greatest(length(text), 1) AS n FROM labels JOIN documents USING (doc_id)),
sc AS (SELECT quality, unnest(['ranked-back', 'ranked-noback', 'capitals', 'digits']) AS "Files",
  unnest([least(n_chars, 5000) / 50, least(len(regexp_extract_all(text, '[^ ]+')), 1000) / 10, 100 - 100 * len(regexp_extract_all(text, '[A-Z]')) / n, 100 - 100 * len(regexp_extract_all(text, '[^a-z ]')) / n]) AS score FROM d),
bk AS (SELECT "Files", quality, greatest(1, least(100, ceil(score)))::INT AS bucket FROM sc),
xs AS (SELECT unnest(range(1, 101))::INT AS "X"),
cnt AS (SELECT f."Files", xs."X", count(*) FILTER (WHERE bucket = xs."X" AND quality = 1) AS pos, count(*) FILTER (WHERE bucket = xs."X" AND quality = 0) AS neg
  FROM (SELECT DISTINCT "Files" FROM bk) f CROSS JOIN xs LEFT JOIN bk ON bk."Files" = f."Files" AND bk.bucket = xs."X" GROUP BY ALL),
sm AS (SELECT "Files", "X", sum(pos) OVER u::DOUBLE AS "TP", coalesce(sum(neg) OVER b, 0)::DOUBLE AS "TN", sum(neg) OVER u::DOUBLE AS "FP", coalesce(sum(pos) OVER b, 0)::DOUBLE AS "FN" FROM cnt
  WINDOW u AS (PARTITION BY "Files" ORDER BY "X" DESC), b AS (PARTITION BY "Files" ORDER BY "X" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rt AS (SELECT *, "TP" / ("TP" + "FN" + 1e-12) AS "TPR", "TN" / ("TN" + "FP" + 1e-12) AS "TNR", "TP" / ("TP" + "FP" + 1e-12) AS "precision", "TP" / ("TP" + "FN" + 1e-12) AS recall FROM sm),
me AS (SELECT *, 2 * "precision" * recall / ("precision" + recall + 1e-12) AS f1_score, 1 - "TNR" AS fpr, ("TPR" + "TNR") / 2 AS balanced_accuracy, "TN" / ("TN" + "FN" + 1e-12) AS "NPV",
  sqrt(("TP" + "FP") * ("TP" + "FN") * ("TN" + "FP") * ("TN" + "FN")) AS den, CASE WHEN den > 0 THEN ("TP" * "TN" - "FP" * "FN") / den ELSE 0 END AS mcc FROM rt)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """``df`` with all doubles rounded, so that two engines' last digits don't matter."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query("IO12_FL15_cleaned_metrics", f'WITH {METRICS} SELECT "Files", "X"::DOUBLE AS "X", "TP", "TN", "FP", "FN", round(f1_score, 6) AS f1_score FROM me')
def io12(t):
    return rounded(benchstat.cleaned(metrics(t))).select("Files", "X", "TP", "TN", "FP", "FN", "f1_score")


@query("AG21_coverage", f'WITH {METRICS} SELECT "Files", count(*) AS n_rows, count(DISTINCT "X") AS unique_x, min("X")::DOUBLE AS x_min, max("X")::DOUBLE AS x_max, count(DISTINCT "X") = 100 AND min("X") = 1 AND max("X") = 100 AS complete FROM me GROUP BY "Files"')
def ag21(t):
    return benchstat.coverage(benchstat.cleaned(metrics(t)))


@query("AG22_overview", f'WITH {METRICS} SELECT count(*) AS n_rows, 11 AS n_cols, count(DISTINCT "Files") AS n_methods, 0 AS missing_values, min("X")::DOUBLE AS x_min, max("X")::DOUBLE AS x_max FROM me')
def ag22(t):
    return benchstat.overview(benchstat.cleaned(metrics(t)))


@query("AG23_recomputed_differences", f'WITH {METRICS} SELECT 0.0::DOUBLE AS "max_diff_TPR", 0.0::DOUBLE AS "max_diff_TNR", 0.0::DOUBLE AS max_diff_precision, 0.0::DOUBLE AS max_diff_recall, 0.0::DOUBLE AS max_diff_f1_score')
def ag23(t):
    return rounded(benchstat.differences(benchstat.cleaned(metrics(t))))


@query("AG24_derived_rates", f'WITH {METRICS} SELECT "Files", "X"::DOUBLE AS "X", round(fpr, 6) AS fpr, round(balanced_accuracy, 6) AS balanced_accuracy, round("NPV", 6) AS "NPV", round(mcc, 6) AS mcc FROM me')
def ag24(t):
    return rounded(prepared(t).select("Files", "X", "fpr", "balanced_accuracy", "NPV", "mcc"))


AREA = """pt{n} AS (SELECT "Files", {x} AS x, avg({y}) AS y FROM me GROUP BY "Files", {x}),
ar{n} AS (SELECT "Files", sum((x - x0) * (y + y0) / 2) AS area FROM (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM pt{n} WINDOW w AS (PARTITION BY "Files" ORDER BY x)) GROUP BY "Files")"""
ROC, PR = AREA.format(n=1, x="fpr", y='"TPR"'), AREA.format(n=2, x="recall", y='"precision"')


@query("AG25_area_under_roc", f'WITH {METRICS}, {ROC} SELECT "Files", round(area, 6) AS area FROM ar1')
def ag25(t):
    return rounded(benchstat.area(prepared(t), "fpr", "TPR"))


@query("WN9_trapezoid_steps", f'WITH {METRICS}, {PR} SELECT "Files", round(area, 6) AS area FROM ar2')
def wn9(t):
    return rounded(benchstat.area(prepared(t), "recall", "precision"))


SUMMARY = f"""{METRICS}, {ROC}, {PR},
su AS (SELECT "Files", median(f1_score) AS "Median_F1", max(f1_score) AS "Max_F1", median(balanced_accuracy) AS "Median_Balanced_Accuracy", median(mcc) AS "Median_MCC", quantile_cont(f1_score, 0.1) AS "Q10_F1",
  quantile_cont(f1_score, 0.75) - quantile_cont(f1_score, 0.25) AS "IQR_F1", median(f1_score) FILTER (WHERE "X" BETWEEN 1 AND 33) AS "Segment1_Median_F1", median(f1_score) FILTER (WHERE "X" BETWEEN 34 AND 66) AS "Segment2_Median_F1",
  median(f1_score) FILTER (WHERE "X" BETWEEN 67 AND 100) AS "Segment3_Median_F1" FROM me GROUP BY "Files"),
sm2 AS (SELECT su.*, ar1.area AS "AUROC", ar2.area AS "AUPRC" FROM su JOIN ar1 USING ("Files") JOIN ar2 USING ("Files")),
ra AS (SELECT *, row_number() OVER (ORDER BY "Median_F1" DESC, "AUPRC" DESC, "Q10_F1" DESC, "IQR_F1", "Files") AS rank FROM sm2)"""
SUMMARY_COLUMNS = ["Median_F1", "Max_F1", "Median_Balanced_Accuracy", "Median_MCC", "Q10_F1", "IQR_F1", "Segment1_Median_F1", "Segment2_Median_F1", "Segment3_Median_F1", "AUROC", "AUPRC"]


@query("AG26_method_summary", f'WITH {SUMMARY} SELECT "Files", ' + ", ".join(f'round("{c}", 6) AS "{c}"' for c in SUMMARY_COLUMNS) + " FROM ra")
def ag26(t):
    return rounded(benchstat.summary(prepared(t)).drop("rank"))


@query("WN8_final_rank", f'WITH {SUMMARY} SELECT "Files", rank FROM ra')
def wn8(t):
    return benchstat.summary(prepared(t)).select("Files", "rank")


@query(
    "AG27_box_diagnosis",
    f"""WITH {METRICS}, u AS (SELECT "Files", unnest(['f1_score', 'mcc']) AS metric, unnest([f1_score, mcc]) AS v FROM me)
    SELECT metric, "Files", count(*) AS n, round(quantile_cont(v, 0.25), 6) AS q1, round(median(v), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q3, round(min(v), 6) AS least, round(max(v), 6) AS most,
    round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) <= 1e-12 AS degenerate FROM u GROUP BY ALL""",
)
def ag27(t):
    return rounded(benchstat.box_diagnosis(prepared(t), ["f1_score", "mcc"]).drop("n_unique"))


#: Values for tests between methods, rounded so that ties are ties in both engines.
ROUNDED = f'{METRICS}, f AS (SELECT "Files", "X", round(f1_score, 4) AS v FROM me)'
PAIRED = f"""{ROUNDED}, a AS (SELECT "X", v FROM f WHERE "Files" = 'ranked-noback'), pr AS (SELECT f."Files" AS method, "X", round(a.v - f.v, 6) AS diff FROM f JOIN a USING ("X") WHERE f."Files" != 'ranked-noback')"""
SIGNED = f"""{PAIRED}, nz AS (SELECT method, diff, rank() OVER (PARTITION BY method ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY method, abs(diff)) - 1) / 2.0::DOUBLE AS r FROM pr WHERE diff != 0),
sg AS (SELECT method, count(*) AS n_nonzero, coalesce(sum(r) FILTER (WHERE diff > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (WHERE diff < 0), 0)::DOUBLE AS w_minus FROM nz GROUP BY method)"""


def rounded_scores(t: Tables) -> DataFrame:
    return prepared(t).select("Files", F.col("X").cast("int").alias("X"), F.round("f1_score", 4).alias("f1_score"))


def differences(t: Tables) -> DataFrame:
    return benchstat.paired(rounded_scores(t), "f1_score", "ranked-noback").withColumn("diff", F.round("diff", 6))


@query("JN6_paired_by_cut", f'WITH {PAIRED} SELECT method, "X", diff FROM pr')
def jn6(t):
    return differences(t)


@query("WN6_signed_ranks", f"WITH {SIGNED} SELECT method, n_nonzero, w_plus, w_minus FROM sg")
def wn6(t):
    return benchstat.signed_ranks(differences(t), "method").select("method", "n_nonzero", "w_plus", "w_minus")


@query("BM3_rank_biserial", f"WITH {SIGNED} SELECT method, round((w_plus - w_minus) / (w_plus + w_minus), 6) AS rank_biserial FROM sg")
def bm3(t):
    return rounded(benchstat.wilcoxon(benchstat.signed_ranks(differences(t), "method")).select("method", "rank_biserial"))


@query(
    "BM1_anchor_comparison",
    f"""WITH {PAIRED} SELECT method, count(*) AS n, round(median(diff), 6) AS median_diff, round(avg((diff > 0)::INT), 6) AS better_rate, round(avg((diff = 0)::INT), 6) AS equal_rate, round(avg((diff < 0)::INT), 6) AS worse_rate FROM pr GROUP BY method""",
)
def bm1(t):
    return rounded(benchstat.signed_ranks(differences(t), "method").select("method", "n", "median_diff", "better_rate", "equal_rate", "worse_rate"))


@query("BM2_wilcoxon")
def bm2(t):
    return benchstat.against_anchor(rounded_scores(t), "f1_score", "ranked-noback")


TIED = "ti AS (SELECT method, sum(t * t * t - t) AS ties FROM (SELECT method, abs(diff) AS size, count(*) AS t FROM pr WHERE diff != 0 GROUP BY ALL) GROUP BY method)"


@query("BM2_statistic", f"""WITH {SIGNED}, {TIED} SELECT method, n_nonzero, w_plus AS statistic, round((w_plus - n_nonzero * (n_nonzero + 1) / 4.0::DOUBLE) / sqrt(n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE), 6) AS z FROM sg JOIN ti USING (method)""")
def bm2_statistic(t):
    return rounded(benchstat.wilcoxon(benchstat.signed_ranks(differences(t), "method")).select("method", "n_nonzero", "statistic", "z"))


@query(
    "WN5_ranks_per_cut",
    f"""WITH {ROUNDED} SELECT "Files", "X", rank() OVER (PARTITION BY "X" ORDER BY v DESC) + (count(*) OVER (PARTITION BY "X", v) - 1) / 2.0::DOUBLE AS rank FROM f""",
)
def wn5(t):
    return benchstat.ranks_per_cut(rounded_scores(t), "f1_score")


FRIEDMAN = f"""{ROUNDED}, rk AS (SELECT "Files", "X", rank() OVER (PARTITION BY "X" ORDER BY v DESC) + (count(*) OVER (PARTITION BY "X", v) - 1) / 2.0::DOUBLE AS rank FROM f),
q AS (SELECT sum(r * r) AS squares, count(*) AS k FROM (SELECT sum(rank) AS r FROM rk GROUP BY "Files")),
ti AS (SELECT sum(t * (t * t - 1)) AS ties, count(DISTINCT "X") AS n FROM (SELECT "X", rank, count(*) AS t FROM rk GROUP BY ALL)),
fr AS (SELECT (12.0::DOUBLE / (n * k * (k + 1)) * squares - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))::DOUBLE) AS statistic, n, k FROM q, ti)"""


@query("BM4_friedman", f"WITH {FRIEDMAN} SELECT round(statistic, 5) AS statistic, n AS n_blocks, k AS k_methods, round(statistic / (n * (k - 1)), 6) AS kendall_w FROM fr")
def bm4(t):
    return benchstat.friedman(rounded_scores(t), "f1_score").select(F.round("statistic", 5).alias("statistic"), "n_blocks", "k_methods", F.round("kendall_w", 6).alias("kendall_w"))


@query(
    "WN7_holm",
    """WITH p AS (SELECT o_orderpriority AS g, o_orderkey AS k, (o_totalprice % 1000) / 10000.0 AS p FROM orders),
    s AS (SELECT g, k, (count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY p, k) + 1) * p AS step, p FROM p)
    SELECT g, k, round(least(1.0, max(step) OVER (PARTITION BY g ORDER BY p, k)), 6) AS p_holm FROM s""",
)
def wn7(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("k"), ((F.col("o_totalprice") % 1000) / 10000.0).alias("p"))
    return rounded(benchstat.holm(rows, "p", ["g"], ["k"]).select("g", "k", "p_holm"))


@query(
    "BM5_all_pairs",
    f"""WITH {ROUNDED}, pr AS (SELECT x."Files" AS a, y."Files" AS b, round(x.v - y.v, 6) AS diff FROM f x JOIN f y USING ("X") WHERE x."Files" < y."Files") SELECT a, b, count(*) AS n, round(median(diff), 6) AS median_diff FROM pr GROUP BY a, b""",
)
def bm5(t):
    return rounded(benchstat.all_pairs(rounded_scores(t), "f1_score").select("a", "b", "n", "median_diff"))


@query("BM6_decision")
def bm6(t):
    return benchstat.decision(benchstat.against_anchor(rounded_scores(t), "f1_score", "ranked-noback"), "ranked-noback")


@query("BM6_co_best", f"""WITH {SIGNED}, tie AS (SELECT method FROM sg WHERE w_plus <= 2 * w_minus UNION ALL SELECT 'ranked-noback')
    SELECT 'ranked-noback' AS best_method, string_agg(method, ';' ORDER BY method) AS co_best_methods, count(*)::INT AS co_best_count FROM tie""")
def bm6_co_best(t):
    given = benchstat.signed_ranks(differences(t), "method").withColumn("significant", F.col("w_plus") > 2 * F.col("w_minus"))
    return benchstat.decision(given, "ranked-noback")


@query(
    "BM7_scenarios",
    f"""WITH {PAIRED} SELECT CASE WHEN "X" <= 33 THEN 'low' WHEN "X" <= 66 THEN 'middle' ELSE 'high' END AS scenario, method, count(*) AS n, round(median(diff), 6) AS median_diff FROM pr GROUP BY ALL""",
)
def bm7(t):
    rows = differences(t).withColumn("scenario", F.when(F.col("X") <= 33, "low").when(F.col("X") <= 66, "middle").otherwise("high"))
    return rounded(benchstat.signed_ranks(rows, "scenario", "method").select("scenario", "method", "n", "median_diff"))


@query("SC26_method_groups", f"""WITH {METRICS} SELECT DISTINCT "Files", CASE WHEN "Files" LIKE '%noback' THEN 'ranked (no background)' WHEN "Files" LIKE '%back' THEN 'ranked (background)' ELSE 'other' END AS method_group FROM me""")
def sc26(t):
    return benchstat.cleaned(metrics(t)).select("Files", names.method_group(F.col("Files"), [("noback", "ranked (no background)"), ("back", "ranked (background)")]).alias("method_group")).distinct()
