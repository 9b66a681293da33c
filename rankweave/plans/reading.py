"""Queries that read running text: signals, grades, facets, markers, claims and protocols.

Whole documents are read.  Each holds one of a table of sentences in its
middle, since the tables' invented prose gives no signal of its own; what the
sentences say was written down by hand, and the SQL looks that up by the
sentence that it finds in the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, texts
from ..operators import articles, gates, references
from ..sources import files
from .registry import Tables, query

SRC, MID, DST = ["Alpha beta", "A. beta"], ["gamma acid"], ["colitis"]
APART = "Here a plain sentence of some more words stands between the two parts of this text."

#: Sentences, and the kind of evidence that each gives.
CASES = [
    ("Alpha beta was cultured in pure culture and produced gamma acid, which was quantified.", "direct_monoculture_production"),
    ("In pure culture Alpha beta was grown and gamma acid was not detected by hplc.", "direct_monoculture_nonproduction"),
    ("Mice were treated with Alpha beta in colitis.", "candidate_microbe_disease_intervention"),
    ("Administration of gamma acid in mice with colitis.", "candidate_metabolite_disease_intervention"),
    ("In a co-culture we added Alpha beta; gamma acid was measured.", "indirect_ecological_evidence"),
    ("Alpha beta goes with gamma acid.", "candidate_pair_association"),
    ("Alpha beta. A defined medium.", "analogous_method_only"),
    ("Colitis is a disease.", "background_only"),
    ("Nothing of note.", "unrelated"),
    ("Alpha beta was grown in a community of many and produced gamma acid.", "candidate_pair_association"),
    ("No production of gamma acid by Alpha beta, which was cultured in monoculture, was measured.", "direct_monoculture_nonproduction"),
    ("Alpha beta did not produce gamma acid.", "candidate_pair_association"),
    ("Rats were gavaged with Alpha beta, a mixture, in colitis.", "background_only"),
    ("Gamma acid treatment attenuated colitis.", "candidate_metabolite_disease_intervention"),
    ("Colitis was reduced by Alpha beta.", "background_only"),
    ("Alpha beta was depleted from the microbial consortium and gamma acid quantified.", "indirect_ecological_evidence"),
    ("This review tells that Alpha beta was cultured in pure culture and produced gamma acid, as measured.", "candidate_pair_association"),
    ("Alphabeta and gammaacid are names of their own.", "unrelated"),
    ("Alpha beta was cultured in pure culture. Gamma acid was produced by Other species, as measured.", "candidate_pair_association"),
    ("Alpha beta was not\nadministered in colitis.", "background_only"),
    ("In axenic culture Alpha beta was grown. It was found that it secreted gamma acid. The yield was measured by nmr.", "direct_monoculture_production"),
    ("Supplementation with live Alpha beta protected mice; colitis was mild.", "candidate_microbe_disease_intervention"),
]
#: By hand, what each of the sentences says: (c) the source was cultured, (p) the intermediate is produced, (n) it isn't, (a) another makes it, (g) the source was
#: given alone, (m) the intermediate was, (e) the source has an effect, (f) the intermediate has, (x) the source was added or taken away.
#: "Not" within 25 characters behind a match negates it, so the second sentence doesn't say (x).
SAYS = ["cpx", "cn", "g", "m", "x", "", "", "", "", "px", "cn", "", "x", "mf", "e", "x", "cpx", "", "cpax", "", "cpx", "ge"]
#: Conditions, levels of support and references that stand in texts.
CONDITIONS = ["Mice had 5 mg/kg for 24 h.", "Caco-2 and RAW264.7 cells in 10 uM; then 2.5 mM, 10 uM.", "DSS-induced colitis in C57BL/6J over 3 weeks and 2 days", "3 x 10^8 CFU of it, in Wistar rats", "no condition", "Tests took 48 hours", "THP-1"]
#: By hand, the markers of each: amounts, times, cells, animals.
MARKED = ["5 mg/kg|24 h", "10 uM|2.5 mM|Caco-2|RAW264.7", "3 weeks|2 days|DSS-induced colitis|C57BL/6J", "3 x 10^8 CFU|Wistar", "", "48 hours", "THP-1"]
LEVELS = ["Direct support.", "Speculative claim.", "Well supported.", "Not supported by data.", "An inference.", "UNSUPPORTED.", "It is overstated.", "Uncertain."]
REFERENCES = [" [PMID: 12; 13] and https://x.example/a?b=1 so", " PMCID: PMC77 (pmc: 8) |after", " protocols.io/view/x and Protocols.IO", " plain", "|", " [pmid:9]https://y"]
MODELS = ["DSS in mice.", "Dextran sodium sulfate was used.", "Murine colitis.", "An organoid.", "Participants of a cohort.", "Mouse tissue.", "In vivo work.", "Tea."]


def planted(t: Tables, sentences: list[str], glue: str = f". {APART} ", end: str = f" {APART} ") -> DataFrame:
    """(doc_id, lang, k, text): every document with a sentence, chosen by its length, in its middle."""
    k = F.pmod("n_chars", F.lit(len(sentences))).cast("int")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    body = F.coalesce("text", F.lit(""))
    parts = [F.left(body, half), F.lit(glue), F.element_at(F.array(*map(F.lit, sentences)), k + 1), F.lit(end), F.substr(body, half + 1)]
    return t.documents.select("doc_id", "lang", k.alias("k"), F.concat(*parts).alias("text"))


#: What is left of a text up to the end of its sentence, or all of it.  No marker spans such an end.
TO_SENTENCE_END = r"(?s)^.*?(?:[.!?](?=\s)|\z)"


def planted_between(t: Tables, sentences: list[str]) -> DataFrame:
    """(doc_id, text): as ``planted``, but behind the first sentence that ends in the second half, so that no word is cut into a marker that the document doesn't hold."""
    k = F.pmod("n_chars", F.lit(len(sentences))).cast("int")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    body = F.coalesce("text", F.lit(""))
    rest = F.substr(body, half + 1)
    cut = F.length(F.regexp_extract(rest, TO_SENTENCE_END, 0))
    parts = [F.left(body, half), F.left(rest, cut), F.lit(f". {APART} "), F.element_at(F.array(*map(F.lit, sentences)), k + 1), F.lit(f" {APART} "), F.substr(rest, cut + 1)]
    return t.documents.select("doc_id", F.concat(*parts).alias("text"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def planted_sql(sentences: list[str], glue: str = f". {APART} ", end: str = f" {APART} ") -> str:
    values = ", ".join(f"({i}, {quoted(s)})" for i, s in enumerate(sentences))
    return f"""s(k, sentence) AS (VALUES {values}),
    d AS (SELECT doc_id, lang, k, left(coalesce(text, ''), n_chars // 2) || {quoted(glue)} || sentence || {quoted(end)} || substr(coalesce(text, ''), n_chars // 2 + 1) AS text FROM documents JOIN s ON k = n_chars % {len(sentences)}),
    x AS (SELECT doc_id, lang, text, lower(text) AS x FROM d)"""


def said_sql(**flags: str) -> str:
    """What the planted sentence of each document says, by the marks given to it by hand."""
    values = ", ".join(f"({quoted(c[0])}, {quoted(marks)})" for c, marks in zip(CASES, SAYS, strict=True))
    # a mixture's name anywhere in the text takes the marks of what was given
    mixed = "regexp_matches(lower(text), 'cocktail|consortium|multi-strain|multistrain|compound probiotic|mixture|blend|synbiotic|formula|as part of|containing strains') AND NOT regexp_matches(lower(text), 'alone|only group|single-strain|monotherapy|individual strain')"
    found = ", ".join(f"contains(marks, '{mark}')" + (f" AND NOT ({mixed})" if mark in "gm" else "") + f" AS {name}" for name, mark in flags.items())
    return f"WITH {planted_sql([c[0] for c in CASES])}, says(phrase, marks) AS (VALUES {values}) SELECT doc_id, {found} FROM d JOIN says ON contains(text, '{APART} ' || phrase || ' {APART}')"


@query("TX1_culture_signal", said_sql(signal="c"))
def tx1(t):
    return planted(t, [c[0] for c in CASES]).select("doc_id", articles.cultured(F.col("text"), SRC).alias("signal"))


@query("TX2_production_signal", said_sql(produced="p", not_produced="n", by_another="a"))
def tx2(t):
    x = F.col("text")
    signals = {"produced": articles.produced(x, MID), "not_produced": articles.not_produced(x, MID), "by_another": articles.by_another(x, SRC, MID)}
    return planted(t, [c[0] for c in CASES]).select("doc_id", *[c.alias(k) for k, c in signals.items()])


def graded_sql(columns: str) -> str:
    """What each document's planted sentence says, found in the whole text."""
    relevance = {"candidate_pair_association": "partial", "analogous_method_only": "analogous", "background_only": "partial", "unrelated": "unrelated"}  # all else is direct, and may be cited
    values = ", ".join(f"({quoted(s)}, {quoted(kind)}, {quoted(relevance.get(kind, 'direct'))}, {kind not in relevance})" for s, kind in CASES)
    return f"WITH {planted_sql([c[0] for c in CASES])}, says(phrase, evidence_type, relevance, citable) AS (VALUES {values}) SELECT {columns} FROM d JOIN says ON contains(text, '{APART} ' || phrase || ' {APART}')"


REVIEWED = "lower(text) LIKE '%this review%'"


@query("TX3_nonproduction_signal", graded_sql(f"doc_id, evidence_type = 'direct_monoculture_production' OR {REVIEWED} AS direct_monoculture_production, evidence_type = 'direct_monoculture_nonproduction' AS direct_monoculture_nonproduction"))
def tx3(t):
    rows = planted(t, [c[0] for c in CASES])
    flags = ["direct_monoculture_production", "direct_monoculture_nonproduction"]
    return rows.select("doc_id").join(articles.windowed_signals(rows, SRC, MID, DST).select("doc_id", *flags), "doc_id", "left").na.fill(False, flags)


@query("TX4_intervention_signal", said_sql(source_given="g", mid_given="m", source_effect="e", mid_effect="f", source_changed="x"))
def tx4(t):
    x = F.col("text")
    signals = {"source_given": articles.administered(x, SRC), "mid_given": articles.administered(x, MID), "source_effect": articles.effective(x, SRC), "mid_effect": articles.effective(x, MID), "source_changed": articles.manipulated(x, SRC)}
    return planted(t, [c[0] for c in CASES]).select("doc_id", *[c.alias(k) for k, c in signals.items()])


#: Sentences, and by hand whether each says that the source, and the intermediate, had an effect on the target.
EFFECTS = [
    ("Alpha beta treatment attenuated colitis in mice.", True, False),
    ("Gamma acid reduced colitis in an organoid.", False, True),
    ("Alpha beta attenuated colitis.", False, False),
    ("Alpha beta attenuated colitis. The work was done in vivo.", True, False),
    ("Mice had colitis. It was ameliorated after gamma acid.", False, True),
    ("Alpha beta did not attenuate colitis in mice.", False, False),
    ("Without doubt Alpha beta improved colitis in mice.", False, False),
    ("Abundance of Alpha beta was high and Alpha beta protected mice from colitis.", False, False),
    ("Serum levels differed; gamma acid reduced colitis in mice.", False, False),
    ("This review tells that gamma acid reduced colitis in mice.", False, False),
    ("Alpha beta improved the weight of mice.", False, False),
    ("In mice with colitis a diet improved the weight, and Alpha beta was there.", False, False),
    ("A. beta was found to suppress colitis in murine cells.", True, False),
    ("A. beta itself suppressed colitis in murine cells.", True, False),
    ("Nothing of note.", False, False),
]
EFFECT_SQL = ", ".join(f"({quoted(x)}, {a}, {b})" for x, a, b in EFFECTS)


@query("TX4_effect_signal", f"WITH {planted_sql([c[0] for c in EFFECTS])}, says(phrase, source_effect, mid_effect) AS (VALUES {EFFECT_SQL}) SELECT doc_id, source_effect, mid_effect FROM d JOIN says ON contains(text, '{APART} ' || phrase || ' {APART}')")
def tx4_effect(t):
    rows = planted(t, [c[0] for c in EFFECTS])
    of = lambda names, flag: articles.effects(rows, names, DST).withColumnRenamed("effect", flag)
    return of(SRC, "source_effect").join(of(MID, "mid_effect"), "doc_id")


@query("TX4_ecology_signal", graded_sql("doc_id, evidence_type = 'indirect_ecological_evidence' AS signal"))
def tx4_ecology(t):
    rows = planted(t, [c[0] for c in CASES])
    return rows.select("doc_id").join(articles.windowed_signals(rows, SRC, MID, DST).select("doc_id", F.col("indirect_ecological_evidence").alias("signal")), "doc_id", "left").na.fill(False, ["signal"])


@query("TX5_article_grades", graded_sql("doc_id, evidence_type, relevance, citable"))
def tx5(t):
    return articles.graded(planted(t, [c[0] for c in CASES]), SRC, MID, DST)


@query("TX7_assessment_status", f"SELECT lang, CASE WHEN bool_or(evidence_type = 'direct_monoculture_production') AND bool_or(evidence_type = 'direct_monoculture_nonproduction') THEN 'conflicting' WHEN bool_or(evidence_type IN ('direct_monoculture_production', 'direct_monoculture_nonproduction')) THEN 'direct' WHEN bool_or(citable) THEN 'indirect' ELSE 'not_found' END AS status FROM ({graded_sql('lang, evidence_type, citable')}) GROUP BY lang")
def tx7(t):
    rows = planted(t, [c[0] for c in CASES])
    return articles.assessed(articles.graded(rows, SRC, MID, DST).join(rows.select("doc_id", "lang"), "doc_id"), "lang")


@query("TX6_evidence_facets", f"""WITH {planted_sql([c[0] for c in CASES])},
    f AS (SELECT lang, doc_id, regexp_matches(x, 'no significant|not significant|contradict|negative result|null finding|not associated|inconsistent|failed to') AS against,
          regexp_matches(x, 'in vitro|cell|epithelial|organoid|macrophage|monocyte|co-culture|mouse|mice|murine|animal|rat|colitis|gnotobiotic|germ-free') AS exp, contains(x, 'gamma acid') AS mid, contains(x, 'colitis') AS dst
          FROM x QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 24),
    h AS (SELECT lang, 'mid' AS topic, mid AS hit, against, exp, doc_id FROM f UNION ALL SELECT lang, 'dst', dst, against, exp, doc_id FROM f),
    n AS (SELECT lang, topic, count_if(hit AND against) AS c, count_if(hit AND NOT against AND exp) AS e, count_if(hit AND NOT against) AS s, list(doc_id ORDER BY doc_id) FILTER (WHERE hit) AS ids FROM h GROUP BY lang, topic)
    SELECT lang, topic, CASE WHEN c > 0 AND s > 0 THEN 'conflicting' WHEN e > 0 THEN 'direct' WHEN s > 0 THEN 'indirect' WHEN c > 0 THEN 'contradicting' ELSE 'not_found' END AS support_level, s AS n_support, c AS n_contradict, coalesce(list_aggregate(ids[1:6], 'string_agg', ','), '') AS ids FROM n""")
def tx6(t):
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    rows = planted(t, [c[0] for c in CASES]).withColumn("nth", nth).filter("nth <= 24")  # a bound on the rank itself, so that no other text moves
    at = F.col("nth") - 1
    low = F.lower("text")
    topics = {"mid": F.contains(low, F.lit("gamma acid")), "dst": F.contains(low, F.lit("colitis"))}
    out = articles.facets(rows.select("lang", F.col("doc_id").alias("id"), "text", at.alias("at")), topics, keys=["lang"])
    return out.select("lang", "topic", "support_level", "n_support", "n_contradict", F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"))


PROTOCOL_TERMS = ["Blog", "https", "news", "en", "", "the"]


@query("TX8_protocol_scores", r"""WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, url, coalesce(html, '') AS html, lower(concat_ws(' ', url, html)) AS x FROM pages),
    one AS (SELECT host, arg_max(page_id, page_id) AS page_id, arg_max(x, page_id) AS x, min(page_id) AS at FROM p WHERE coalesce(host, '') != '' GROUP BY host)
    SELECT host, 2 * (contains(x, 'blog')::INT + contains(x, 'https')::INT + contains(x, 'news')::INT + contains(x, 'en')::INT + contains(x, 'the')::INT) + (page_id % 3 = 0)::INT + 2 * (page_id % 5 = 0)::INT AS score,
           CASE WHEN regexp_matches(x, 'in vitro|cell|culture|organoid|epithelial|macrophage|fermentation|metabolite') THEN CASE WHEN regexp_matches(x, 'in vivo|mouse|mice|murine|animal|colitis|dss|gavage') THEN 'in_vitro|in_vivo' ELSE 'in_vitro' END
                WHEN regexp_matches(x, 'in vivo|mouse|mice|murine|animal|colitis|dss|gavage') THEN 'in_vivo' ELSE 'unspecified' END AS models
    FROM one WHERE contains(x, 'blog') OR contains(x, 'https') OR contains(x, 'news') OR contains(x, 'the')""")
def tx8(t):
    host = F.regexp_extract("url", "//([^/]*)", 1)
    items = t.pages.select(host.alias("host"), "page_id", F.col("url").alias("title"), F.col("html").alias("body"), F.when(F.col("page_id") % 3 == 0, "10.1/x").alias("doi"), (F.col("page_id") % 5 == 0).alias("peer_reviewed"))
    return articles.ranked_protocols(items, "host", "page_id", PROTOCOL_TERMS).select("host", "score", F.array_join("models", "|").alias("models"))


@query("TX9_parsed_sections", r"""WITH p AS (SELECT *, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_') AS name, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS brand FROM part)
    SELECT 'node' AS kind, name AS a, CASE p_size % 5 WHEN 0 THEN 'microbe' WHEN 2 THEN 'disease' WHEN 3 THEN 'pathway' ELSE 'metabolite' END AS b, NULL AS c, CASE WHEN p_size % 7 = 0 THEN '' ELSE p_type || ', ' || p_brand END AS description FROM p
    UNION ALL SELECT 'edge', name, brand, CASE p_size % 3 WHEN 0 THEN 'produces' WHEN 2 THEN 'inhibits' ELSE 'associated_with' END, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'of ' || p_type END FROM p""")
def tx9(t):
    size, cut = F.col("p_size"), lambda n, c: F.when(F.col("p_size") % n == 0, F.lit("")).otherwise(c)
    kind = F.element_at(F.array(*map(F.lit, ["Microbe", "planet", " Disease", "pathway", ""])), (size % 5 + 1).cast("int"))
    relation = F.element_at(F.array(*map(F.lit, ["produces", "unknown", "Inhibits"])), (size % 3 + 1).cast("int"))
    node = F.concat("p_name", F.lit(","), kind, cut(7, F.concat(F.lit(", "), "p_type", F.lit(", "), "p_brand")))
    edge = F.concat("p_name", F.lit(", "), "p_brand", F.lit(","), relation, cut(4, F.concat(F.lit(",of "), "p_type")))
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", c.alias("line")))), lambda x: x["line"]), "\n")
    doc = t.part.groupBy(F.floor(F.col("p_partkey") / 20).alias("doc")).agg(lines(node).alias("n"), lines(edge).alias("e"))  # twenty lines a text
    text = F.concat(F.lit("<think>===BEGIN NODES===\nx,y\n===END NODES===</think>```text\n===BEGIN NODES===\nid,type,description\n[note]\n\n"), "n", F.lit("\n===END NODES===\n===BEGIN EDGES===\nsource,target,relation,description\n"), "e", F.lit("\n===END EDGES===\n```"))
    out = articles.parsed_sections(doc.select("doc", text.alias("response")), "doc", "response", ["produces", "inhibits"])
    return out.select("kind", F.coalesce("id", "source").alias("a"), F.coalesce("type", "target").alias("b"), F.col("relation").alias("c"), "description")


MARKER_SQL = f"""marked(phrase, markers) AS (VALUES {", ".join(f"({quoted(c)}, {quoted(m)})" for c, m in zip(CONDITIONS, MARKED, strict=True))}),
    marks AS (SELECT doc_id, markers FROM d JOIN marked ON contains(text, '{APART} ' || phrase || ' {APART}'))"""


@query("SC22_condition_markers", f"WITH {planted_sql(CONDITIONS)}, {MARKER_SQL} SELECT doc_id, markers FROM marks")
def sc22(t):
    return planted_between(t, CONDITIONS).select("doc_id", F.array_join(texts.markers(F.col("text")), "|").alias("markers"))


def in_methods(t: Tables) -> DataFrame:
    section = F.when(F.col("lang") == "en", "Methods|x").when(F.col("lang") == "fr", "MATERIALS").otherwise("intro")
    return planted(t, CONDITIONS).withColumn("section", section)


#: SQL of a text whose letters beyond ASCII are x, so that ends of words are the same to both engines.
PLAIN = r"regexp_replace({0}, '[^\P{{L}}a-zA-Zμ]', 'x', 'g')"


@query("FL14_methods_passages", f"""WITH {planted_sql(CONDITIONS)}, {MARKER_SQL}, k AS (SELECT 4 * doc_id AS id, text, lang, '' AS markers FROM d UNION ALL SELECT 4 * doc_id + 1, left('{APART}', 60), lang, '' FROM d
      UNION ALL SELECT 4 * doc_id + 2, phrase, lang, marked.markers FROM d JOIN marks USING (doc_id) JOIN marked USING (markers)
      UNION ALL SELECT 4 * doc_id + 3, left(text, 60), lang, CASE WHEN {" OR ".join(f"regexp_matches({PLAIN.format('left(text, 60)')}, {quoted(m)})" for m in texts.MARKERS)} THEN 'some' ELSE '' END FROM d)
    SELECT id AS doc_id FROM k WHERE lang IN ('en', 'fr') AND (length(text) >= 80 OR markers != '')""")
def fl14(t):
    rows = in_methods(t)
    phrase = F.element_at(F.array(*map(F.lit, CONDITIONS)), F.col("k") + 1)
    forms = [F.col("text"), F.substr(F.lit(APART), F.lit(1), F.lit(60)), phrase, F.left("text", F.lit(60))]  # whole, too short and without a marker, the condition alone, the document's own beginning
    each = F.explode(F.array(*[F.struct((F.col("doc_id") * 4 + i).alias("doc_id"), x.alias("text")) for i, x in enumerate(forms)])).alias("x")
    return articles.method_passages(rows.select("section", each).select("section", "x.doc_id", "x.text")).select("doc_id")


CELL_SQL = "(regexp_matches(lower(text), 'in vitro|cell|epithelial|organoid|macrophage|monocyte|co-culture') OR regexp_matches(markers, 'Caco-2|THP-1'))"
ANIMAL_SQL = "(regexp_matches(lower(text), 'mouse|mice|murine|animal|rat|colitis|gnotobiotic|germ-free') OR regexp_matches(markers, 'C57BL|Wistar'))"


@query("TX10_method_passages", f"""WITH {planted_sql(CONDITIONS)}, {MARKER_SQL},
    e AS (SELECT lang, doc_id, 'PMID ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '; PMCID PMC' || doc_id ELSE '' END AS citation, CASE WHEN {ANIMAL_SQL} THEN 'in_vivo' WHEN {CELL_SQL} THEN 'in_vitro' ELSE 'unspecified' END AS model_type,
                 coalesce(markers, '') AS conditions, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^[ .;,:]+|[ .;,:]+$', '', 'g') AS phrase FROM d LEFT JOIN marks USING (doc_id) WHERE lang IN ('en', 'fr')),
    k AS (SELECT *, 'all' AS kind FROM e UNION ALL SELECT *, model_type FROM e WHERE model_type != 'unspecified')
    SELECT lang, kind, row_number() OVER (PARTITION BY lang, kind ORDER BY doc_id) AS nth, citation, model_type, conditions, citation || ': ' || CASE WHEN length(phrase) > 280 THEN rtrim(left(phrase, 279)) || '…' ELSE phrase END AS summary
    FROM k QUALIFY nth <= 8""")
def tx10(t):
    rows = in_methods(t).withColumns({"pmid": F.col("doc_id").cast("string"), "pmcid": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("PMC"), "doc_id"))})
    return articles.method_evidence(rows, "lang", "doc_id").withColumn("conditions", F.array_join("conditions", "|"))


@query("TX11_backfilled_fields", """WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS pos FROM benchmark),
    f AS (SELECT item_id, arg_min(trim(word), pos) AS word, min(pos) AS pos FROM w WHERE trim(word) != '' GROUP BY item_id, lower(trim(word)))
    SELECT item_id, CASE WHEN item_id % 3 = 1 THEN max(word) FILTER (WHERE pos = 1) ELSE string_agg(word, '|' ORDER BY pos) END AS v FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 6) GROUP BY item_id""")
def tx11(t):
    words = F.split("text", " ")
    own = F.when(F.col("item_id") % 3 == 1, F.slice(words, 1, 1)).when(F.col("item_id") % 3 == 2, F.array().cast("array<string>"))
    return t.benchmark.select("item_id", F.array_join(articles.backfilled(own, words), "|").alias("v"))


@query("FL18_supported_claims", f"WITH {planted_sql(LEVELS)} SELECT doc_id FROM x WHERE doc_id % 3 > 0 AND NOT regexp_matches(x, 'speculative|unsupported|overstated|inference|uncertain|not supported')")
def fl18(t):
    ids = F.when(F.col("doc_id") % 3 > 0, F.array("doc_id")).otherwise(F.array().cast("array<long>"))
    return planted(t, LEVELS).filter(articles.supported(ids, F.col("text"))).select("doc_id")


@query("AG31_completeness", "SELECT l_orderkey, CASE WHEN count_if(l_returnflag = 'R') > 0 THEN 'needs_resolution' WHEN count_if(l_returnflag = 'A') > 0 THEN 'decision_complete' ELSE 'execution_complete' END AS design_status FROM lineitem GROUP BY l_orderkey")
def ag31(t):
    issues = lambda flag: F.collect_list(F.when(F.col("l_returnflag") == flag, F.col("l_linenumber")))
    return gates.completeness(t.lineitem.groupBy("l_orderkey").agg(issues("R").alias("b"), issues("A").alias("m")), "b", "m").select("l_orderkey", "design_status")


@query("SC19_claim_key", rf"""WITH {planted_sql(REFERENCES, '', '')},
    r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\[PMID:[^\]]+\]', '', 'g'), '(?i)\bPMCID?:\s*\S+', '', 'g'), 'https?://\S+', '', 'g'), '(?i)protocols\.io\S*', '', 'g') AS text FROM d)
    SELECT doc_id, trim(regexp_replace(regexp_replace(lower(split_part(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ;|,'), '|', 1)), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM r""")
def sc19(t):
    return planted(t, REFERENCES, "", "").select("doc_id", texts.claim_key(F.col("text")).alias("key"))


@query("SC21_allowed_ids", "SELECT l_orderkey, coalesce(string_agg(l_partkey, '|' ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_partkey IN (SELECT r.l_partkey FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_returnflag = 'R')), '') AS ids FROM lineitem l GROUP BY l_orderkey")
def sc21(t):
    own = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    allowed = F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")))
    rows = t.lineitem.groupBy("l_orderkey").agg(own.alias("own"), allowed.alias("allowed"))
    return rows.select("l_orderkey", F.array_join(names.allowed_only(F.col("own"), F.col("allowed")), "|").alias("ids"))


#: All white space that a text may hold, for an engine whose own class is ASCII only.
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query("SC21_references_of_plans", rf"""WITH a AS (SELECT doc_id AS id FROM labels),
    d AS (SELECT doc_id, doc_id::VARCHAR AS own, (doc_id + 1)::VARCHAR AS next, text, doc_id IN (FROM a) AS has_own, doc_id + 1 IN (FROM a) AS has_next FROM documents WHERE text IS NOT NULL),
    b AS (SELECT *, CASE WHEN has_own THEN 'PMID: ' || own ELSE '' END || ' ; ' || text || ' ' || CASE WHEN has_next THEN '[pmid' || next || ']' ELSE '' END || ' ' || CASE WHEN has_own THEN 'PMID ' || own ELSE '' END || '.' AS body FROM d)
    SELECT doc_id, trim(regexp_replace(regexp_replace(body, '\[{SPACE}*\]', '', 'g'), '{SPACE}+', ' ', 'g'), ' ;,|') AS body,
      concat_ws('|', CASE WHEN has_own THEN own END, CASE WHEN has_next THEN next END) AS ids, CASE WHEN has_next THEN 'as in PMID:' || next || ', twice' ELSE 'as in , twice' END AS note FROM b""")
def sc21_plans(t):
    own, after = F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string")
    body = F.concat(F.lit("PMID: "), own, F.lit(" ; "), "text", F.lit(" [pmid"), after, F.lit("] PMID "), own, F.lit("."))
    step = F.struct(F.array(own, after).alias("representative_pmids"), F.concat(F.lit("as in PMID:"), after, F.lit(", twice")).alias("note"))
    plans = t.documents.filter("text IS NOT NULL").select("doc_id", F.to_json(F.struct(body.alias("body"), F.struct(F.array(F.array(step)).alias("steps")).alias("plan"))).alias("text"))
    clean = references.only_allowed(plans, t.labels.select(F.col("doc_id").alias("id")))
    of = lambda path: F.get_json_object("text", path)
    ids = F.from_json(of("$.plan.steps[0][0].representative_pmids"), "array<string>")
    return clean.select("doc_id", of("$.body").alias("body"), F.array_join(ids, "|").alias("ids"), of("$.plan.steps[0][0].note").alias("note"))


@query("SC23_model_scope", rf"""WITH {planted_sql(MODELS)}, m AS (SELECT doc_id, x, regexp_matches(x, '\b(?:dss|dextran sodium sulfate)\b') AS dss, regexp_matches(x, '\b(?:mouse|mice|murine)\b') AS mouse FROM x)
    SELECT doc_id, CASE WHEN dss AND mouse THEN 'a DSS-induced mouse colitis model' WHEN dss THEN 'a DSS-induced colitis model' WHEN mouse AND regexp_matches(x, 'colitis|inflammatory bowel|ibd') THEN 'a paper-reported mouse colitis model'
        WHEN regexp_matches(x, 'organoid|epithelial cell|macrophage|cell line|in vitro') THEN 'the paper-reported in vitro host model' WHEN regexp_matches(x, 'patients|participants|cohort|clinical') THEN 'the paper-reported human population'
        WHEN mouse THEN 'the paper-reported mouse model' WHEN regexp_matches(x, 'rat|animal|in vivo') THEN 'the paper-reported preclinical model' ELSE 'the paper-reported experimental model' END AS scope FROM m""")
def sc23(t):
    return planted(t, MODELS).select("doc_id", texts.model_scope(F.col("text")).alias("scope"))


#: Statuses as people write them.
RAW = [" Passed", "PASS", "fail", "complete_negative", "equivocal", "whatever", "", "positive", "Negative ", "inconclusive", "ambiguous", "not_run", "failed", "complete_positive", "ready", "Outline_only", "degraded", " blueprint", "needs_resolution", "incomplete", "protocol_complete", "complete"]


@query("SC27_status_vocabularies", f"""WITH s(k, raw) AS (VALUES {", ".join(f"({i}, {quoted(r)})" for i, r in enumerate(RAW))}), r AS (SELECT o_orderkey, lower(trim(raw)) AS s FROM orders JOIN s ON k = (o_orderkey + o_custkey) % {len(RAW)})
    SELECT o_orderkey, CASE WHEN s IN ('passed', 'pass', 'complete_positive', 'positive') THEN 'positive' WHEN s IN ('failed', 'fail', 'complete_negative', 'negative') THEN 'negative' WHEN s IN ('equivocal', 'ambiguous', 'inconclusive') THEN 'inconclusive' ELSE 'not_run' END AS result,
           CASE WHEN s IN ('complete', 'ready', 'protocol_complete', 'execution_complete') THEN 'execution_complete' WHEN s IN ('outline_only', 'blueprint', 'decision_complete') THEN 'decision_complete' WHEN s IN ('degraded', 'incomplete', 'needs_resolution') THEN 'needs_resolution' ELSE '' END AS design FROM r""")
def sc27(t):
    raw = F.element_at(F.array(*map(F.lit, RAW)), (F.pmod(F.col("o_orderkey") + F.col("o_custkey"), F.lit(len(RAW))) + 1).cast("int"))
    return t.orders.select("o_orderkey", names.result_status(raw).alias("result"), names.design_status(raw).alias("design"))


@query("FL6_term_in_text", r"SELECT doc_id, regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])the(?:[^\p{L}\p{N}_]|$)') AS short, contains(lower(text), 'tion') AS long FROM documents")
def fl6(t):
    low = F.lower("text")
    return t.documents.select("doc_id", texts.has_term(low, "The").alias("short"), texts.has_term(low, "tion").alias("long"))


#: Sentences that mention an intermediate once, negated near by, negated from afar or not at all; and by hand whether that is a mention that nothing negates.
MENTIONS = [
    ("We see gamma acid here.", True),
    ("There was no gamma acid.", False),
    ("Neither they nor we saw a trace of any gamma acid.", False),
    ("Not one word of all that follows in this long line of plain and simple things is against gamma acid here.", True),
    ("It was not the gamma acid.", False),
    ("A gammaacid.", False),
    ("They failed to find some gamma acid.", False),
    ("Gamma  acid\nwithout a doubt.", True),
    ("These were unable to make gamma acid.", False),
    ("Nothing but gamma acid was there.", True),
    ("Tubes without it held gamma acid.", False),
    ("We saw no other, and yet of all that was tried in the end it was gamma acid.", True),
    ("A notable amount of gamma acid.", True),
]


@query("FL8_affirmed_mention", f"""WITH {planted_sql([m[0] for m in MENTIONS])}, says(phrase, affirmed) AS (VALUES {", ".join(f"({quoted(x)}, {a})" for x, a in MENTIONS)})
    SELECT doc_id, affirmed FROM d JOIN says ON contains(text, '{APART} ' || phrase || ' {APART}')""")
def fl8(t):
    return planted(t, [m[0] for m in MENTIONS]).select("doc_id", texts.affirms(F.col("text"), MID).alias("affirmed"))


@query("IO15_protocols", """SELECT p_partkey::VARCHAR AS id, 'Step 1: ' || p_name || ' | ' || p_size || ' g | ' || p_brand || '|Step 3: ' || p_type || CASE WHEN p_size % 2 = 0 THEN ' | inner | 37' ELSE '' END AS steps,
    p_brand || ' | vendor: V' || p_size || ' | SKU: S' || p_partkey || ' | https://x/' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '|plain' ELSE '' END AS materials FROM part""")
def io15(t):
    size = F.col("p_size").cast("string")
    # amounts, durations and temperatures lie at several depths; other fields are not text
    one = F.struct(F.concat(F.lit(" <b>"), "p_name", F.lit("</b>")).alias("description"), F.array(F.struct(F.struct(F.concat(size, F.lit("  g")).alias("amount"), F.lit("x").alias("unit")).alias("source"), F.struct(F.upper("p_name").alias("Name"), F.col("p_brand").alias("text")).alias("data"))).alias("components"))
    two = F.struct(F.lit(" ").alias("description"), F.lit(7).alias("number"))
    deep = F.when(F.col("p_size") % 2 == 0, F.struct(F.array(F.array(F.struct(F.lit("inner").alias("Title"), F.lit(37).alias("temperature")))).alias("cases")))
    three = F.struct(F.struct(F.col("p_type").alias("content"), deep.alias("more")).alias("body"))
    body = lambda c: F.to_json(c)
    materials = F.concat(F.lit("["), body(F.struct(F.col("p_brand").alias("name"), F.struct(F.concat(F.lit("V"), size).alias("name")).alias("vendor"), F.concat(F.lit("S"), "p_partkey").alias("sku"), F.concat(F.lit("https://x/"), "p_partkey").alias("url"))), F.when(F.col("p_size") % 2 == 0, F.lit(',{"name":"plain","sku":""},{"name":"PLAIN"}')).otherwise(""), F.lit("]"))
    document = F.concat(F.lit('{"id":'), F.col("p_partkey").cast("string"), F.lit(',"steps":['), body(one), F.lit(","), body(two), F.lit(","), body(three), F.lit('],"materials":'), materials, F.lit("}"))
    return files.protocols(t.part.select(document.alias("j")), "j").select("id", F.array_join("steps", "|").alias("steps"), F.array_join("materials", "|").alias("materials"))


