"""Rules on small tables with known results."""

import itertools
import math
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankweave import ranking
from rankweave.functions import names, texts
from rankweave.operators import articles, audits, benchstat, compose, corpus, embed, energy, gates, graph, ordered, quadrant, refmatch, signal, spectral
from rankweave.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_file_and_row_names(spark):
    lit = F.lit
    assert one(spark, names.from_file_name(lit("d/plus_min0_Akk_muc_seed_1_dim.csv")), names.from_file_name(lit("x_Genus_species_seed_1.csv")), names.from_file_name(lit("none.csv"))) == ("Akk_muc", "Genus_species", None)
    got = one(spark, names.mid_of_row_name(lit('"2-Hydroxy acid-A_b"'), lit("A_b")), names.mid_of_row_name(lit("x-y-z"), lit("A_b")), names.mid_of_row_name(lit("x"), lit("A_b")))
    assert got == ("2-Hydroxy acid", "x-y", "x")


@pytest.mark.parametrize("count,most,want", [(10, 100, 1 - math.log(11) / math.log(101)), (5, 0, 1), (0, 100, 1), (100, 100, 0)])
def test_novelty(spark, count, most, want):
    assert one(spark, quadrant.novelty_by_batch(F.lit(count), F.lit(most)))[0] == pytest.approx(want)


def test_quadrants_and_their_edges(spark):
    q = lambda s, n: quadrant.quadrant(F.lit(s), F.lit(n), F.lit(0.5), F.lit(0.5))
    assert one(spark, q(0.9, 0.9), q(0.3, 0.9), q(0.9, 0.2), q(0.3, 0.2), q(0.5, 0.5)) == ("I", "II", "III", "IV", "II")


def test_dual_end_signal_breaks_ties_by_order_whatever_the_partitions(spark):
    rows = [("a", m, v) for m, v in [("p", 0.0), ("q", 10.0), ("r", 5.0), ("s", 4.0), ("t", 6.0), ("u", None)]]
    df = spark.createDataFrame(rows, "src string, mid string, value double")
    for n in (1, 3):
        got = {r["mid"]: (r["signal"], r["rank_in_src"], r["total_in_src"]) for r in signal.candidates(df.repartition(n)).collect()}
        assert got == {"p": (1.0, 5, 5), "q": (0.8, 1, 5), "s": (0.6, 4, 5), "t": (0.4, 2, 5), "r": (0.2, 3, 5)}


def test_clr_has_mean_zero_in_every_sample(spark):
    df = spark.createDataFrame([(f, s, float((f * 7 + s * 3) % 5 - 1)) for f in range(9) for s in range(4)], "feature int, sample int, value double")
    for r in compose.clr(df, shift=True).groupBy("sample").agg(F.sum("clr").alias("m")).collect():
        assert abs(r["m"]) < 1e-10


def test_gates(spark):
    modules = [("p", m, r, d, o) for m, r, d, o in [("a", "pass", "ready", "all_of"), ("b", "positive", "ready", "all_of"), ("c", "negative", "ready", "any_of"), ("d", "positive", "ready", "all_of"), ("x", "positive", "ready", "all_of"), ("y", "positive", "ready", "all_of"), ("e", "positive", "incomplete", "all_of"), ("f", "not_run", "ready", "all_of"), ("g", "not_run", "ready", "all_of")]]
    clauses = [("p", m, n, g, ["positive"]) for m, n, g in [("b", "a", None), ("c", "b", None), ("c", "missing", None), ("d", "c", None), ("x", "y", None), ("y", "x", None), ("f", "e", None), ("g", None, "Board "), ("e", "missing", None)]]
    out = gates.evaluated(
        spark.createDataFrame(modules, "plan string, module_id string, result_status string, design_status string, operator string"),
        spark.createDataFrame(clauses, "plan string, module_id string, needs string, gate string, accepted array<string>"),
        spark.createDataFrame([("p", "board", "passed")], "plan string, gate string, result_status string"),
    )
    got = {r["module_id"]: r["gate_status"] for r in out.collect()}
    assert got == {"a": "met", "b": "met", "c": "met", "d": "unmet", "x": "unknown", "y": "unknown", "e": "unknown", "f": "unmet", "g": "met"}


def test_paths_avoid_cycles_and_excluded_nodes(spark):
    edges = spark.createDataFrame([(a, b, "r") for a, b in ["ab", "bc", "ca", "cd", "ax", "xd"]], "source string, target string, relation string")
    pairs = spark.createDataFrame([("a", "d")], "start string, end string")
    got = sorted("".join(r["nodes"]) for r in graph.simple_paths(edges, pairs, 3).collect())
    assert got == ["abcd", "axd"]
    between = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    both = sorted("".join(r["nodes"]) for r in graph.simple_paths(edges, pairs, 3, directed=False, between=between).collect())
    assert both == ["abcd", "acd"]


@pytest.mark.parametrize("directed", [True, False])
def test_paths_that_meet_in_the_middle_against_plain_search(spark, directed):
    r = random.Random(12)
    ids = [f"n{i}" for i in range(14)]
    links = sorted({(r.choice(ids), r.choice(ids), r.choice("xy")) for _ in range(34)} | {("hub", i, "x") for i in ids[:8]} | {(i, "hub", "x") for i in ids[6:]})
    inside = [*ids[2:], "hub"]
    step = {(a, b, c) for a, b, c in links} | (set() if directed else {(b, a, c) for a, b, c in links})
    pairs = [(a, b) for a in ids[:4] for b in ids[4:9]] + [("n1", "n1"), ("n1", "gone"), ("hub", "n3")]

    def walk(path, relations, end):
        if path[-1] == end:
            yield tuple(path), tuple(relations)
        elif len(path) <= 4 and (len(path) == 1 or path[-1] in inside):
            for a, b, c in step:
                if a == path[-1] and b not in path:
                    yield from walk([*path, b], [*relations, c], end)

    edges = spark.createDataFrame(links, "source string, target string, relation string")
    want = {(a, b): list(walk([a], [], b)) if a != b else [] for a, b in pairs}
    between = spark.createDataFrame([(i,) for i in inside], "id string")
    asked = spark.createDataFrame(pairs, "start string, end string").repartition(3)
    got = [(x["start"], x["end"], tuple(x["nodes"]), tuple(x["relations"]), x["length"]) for x in graph.simple_paths(edges, asked, 4, directed, between).collect()]
    assert sorted(got) == sorted((a, b, n, c, len(c)) for (a, b), found in want.items() for n, c in found)
    few = graph.shortest(graph.simple_paths(edges, asked, 4, directed, between, k=2), 2).collect()
    text = lambda n, c: n[0] + "".join(f" -[{x}]-> {y}" for x, y in zip(c, n[1:]))
    best = [(a, b, n) for (a, b), found in want.items() for n, c in sorted(found, key=lambda f: (len(f[1]), text(*f)))[:2]]
    assert sorted((x["start"], x["end"], tuple(x["nodes"])) for x in few) == sorted(best)


def test_references_at_any_depth(spark):
    import json

    from rankweave.operators import references

    deep = {"title": "as PMID: 1 and [pmid2] say", "pmids": [1, " 2 ", None, "", "3"], "n": 5, "plans": [{"representative_pmids": ["2"], "pmids": "PMID 3; text"}, [["PMID 4", True, None]], "[PMID:1],  PMID1x ;"]}
    rows = [(1, json.dumps(deep)), (2, "Seen in PMID 1, PMID:3 | "), (3, None), (4, "{not json PMID 2}"), (5, ""), (None, "pmid 9 stays")]
    docs = spark.createDataFrame([(i, "x", t) for i, t in rows], "doc_id long, other string, text string").repartition(3)
    found = {}
    for r in references.references(docs).orderBy("doc_id", "at").collect():
        found.setdefault(r["doc_id"], []).append(r["id"])
    assert found == {1: ["1", "2", "1", "2", "3", "2", "3", "4", "1"], 2: ["1", "3"], 4: ["2"], None: ["9"]}
    out = references.only_allowed(docs, spark.createDataFrame([(1, "2"), (1, "3"), (2, "3"), (None, "9")], "doc_id long, id string"))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == docs.columns
    want = {"title": "as and [pmid2] say", "pmids": ["2", "3"], "n": 5, "plans": [{"representative_pmids": ["2"], "pmids": "PMID 3; text"}, [["", True, None]], "PMID1x"]}
    assert json.loads(got.pop(1)) == want
    assert got == {2: "Seen in , PMID:3", 3: None, 4: "{not json }", 5: "", None: "pmid 9 stays"}
    everywhere = {r["doc_id"]: r["text"] for r in references.only_allowed(docs, spark.createDataFrame([(1,)], "id int")).collect()}
    assert everywhere[2] == "Seen in PMID 1" and everywhere[4] == "{not json }"
    assert references.only_allowed(docs.limit(0), docs.select(F.lit("1").alias("id"))).collect() == []


def test_energy(spark):
    edges = spark.createDataFrame([("a", "b", 2.0, 10, 2024), ("b", "a", 0.0, 5, None), ("b", "c", None, None, None)], "source string, target string, impact double, cites long, year int")
    got = energy.path_scores(edges, spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"])], "path_id int, nodes array<string>"), 2026)
    score = {r["path_id"]: r["score"] for r in got.collect()}
    support = 2.0 * 10 / 3
    assert score[1] == pytest.approx((1 + 1) ** 2 / (1 / (1 + support) + 1)) and score[2] == 0


def test_containment_finds_short_and_long_names(spark):
    words = ["a", "ab", "abc", "xabcx", "zz", "", "bcx", "the abc of"]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    got = {(r["a"], r["b"]) for r in refmatch.either_way(df, df.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert got == {(x, y) for x in words for y in words if x and y and (x in y or y in x)}


def test_evidence_bonus_is_capped_and_levels_use_the_unrounded_value(spark):
    hops = [(1, "source_mid", 3, {str(k): True for k in range(6)}), (1, "mid_target", 3, {}), (2, "source_mid", 0, {"a": False}), (2, "mid_target", 9, {})]
    got = {r["cand"]: r for r in corpus.aggregated(spark.createDataFrame(hops, "cand int, hop string, count long, db_hits map<string,boolean>")).collect()}
    assert (got[1]["db_bonus"], got[1]["chain_count"], got[1]["bottleneck"]) == (50, 53, "source_mid")
    assert (got[2]["chain_count"], got[2]["chain_novelty"], got[2]["recommendation"]) == (0, 1.0, "high")


def test_tails_and_holm(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.6448536269514722, 3.841458820694124)], "z double, x double")
    rows = df.select(benchstat.normal_above("z").alias("n"), benchstat.chi_square_above("x", F.lit(1.0)).alias("c")).collect()
    assert rows[0]["n"] == 0.5 and rows[1]["n"] == pytest.approx(0.05) and rows[1]["c"] == pytest.approx(0.05)
    p = spark.createDataFrame([("g", k, v) for k, v in enumerate([0.01, 0.04, 0.03, 0.5])], "g string, k int, p double")
    got = [r["p_holm"] for r in benchstat.holm(p, "p", ["g"], ["k"]).orderBy("k").collect()]
    assert got == pytest.approx([0.04, 0.09, 0.09, 0.5])


def test_identical_methods_have_p_one(spark):
    rows = [("a", x, 0.5) for x in range(5)] + [("b", x, 0.5) for x in range(5)]
    got = benchstat.against_anchor(spark.createDataFrame(rows, "Files string, X int, f double"), "f", "a").first()
    assert (got["p_value"], got["statistic"], got["rank_biserial"]) == (1.0, 0.0, 0.0)


def test_negation_and_reviews(spark):
    docs = [(1, "Mice with colitis were treated with Alpha beta."), (2, "Mice with colitis were not treated with Alpha beta."), (3, "This review: mice with colitis were treated with Alpha beta."), (4, "In colitis a cocktail: mice were treated with Alpha beta.")]
    got = {r["doc_id"]: r["evidence_type"] for r in articles.graded(spark.createDataFrame(docs, "doc_id int, text string"), ["Alpha beta"], ["gamma"], ["colitis"]).collect()}
    assert got == {1: "candidate_microbe_disease_intervention", 2: "background_only", 3: "background_only", 4: "background_only"}


def test_short_terms_are_whole_words_in_any_script(spark):
    assert one(spark, texts.has_term(F.lit("a réer b"), "er"), texts.has_term(F.lit("an er b"), "er"), texts.has_term(F.lit("xtionx"), "tion")) == (False, True, True)


def test_terms_in_one_pass_and_by_join(spark, monkeypatch):
    texts_ = ["The ABC of er, tion", "abcx réer erx er", None, "", "gut microbe-one; alpha  beta", "ALPHA BETA gut", "xabcx " * 50 + "er", "x" * 100_000 + "abc", "Ⅷ er² (er)"]
    docs = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts_)], "doc_id long, text string, exp boolean").repartition(3)
    terms = spark.createDataFrame([(t,) for t in ["abc", "ABC", " er ", "er", "tion", "alpha beta", "alpha", "microbe", "gut microbe-one", "--", "", None, "abcx"]], "term string")
    got = sorted((r["doc_id"], r["term"], r["exp"]) for r in corpus.incidence(docs, terms, flags=["exp"]).collect())
    want = []
    for i, t in enumerate(texts_):
        for term in {"abc", "ABC", " er ", "er", "tion", "alpha beta", "alpha", "microbe", "gut microbe-one", "abcx"}:
            low, text = term.strip().lower(), (t or "").lower()
            at = [k for k in range(len(text)) if text.startswith(low, k)]
            if any(len(low) > 3 or not (text[k - 1 : k].isalnum() or text[k + len(low) : k + len(low) + 1].isalnum()) for k in at):
                want.append((i, term, i % 2 == 0))
    assert got == sorted(want)
    plan = corpus.incidence(docs, terms)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    monkeypatch.setattr(corpus, "AUTOMATON", 0)
    assert corpus.incidence(docs, terms.limit(0)).collect() == []
    plain = terms.filter("term NOT IN (' er ', 'ABC')")  # the join trims no term
    assert sorted((r["doc_id"], r["term"]) for r in corpus.incidence(docs, plain).collect()) == sorted((i, t) for i, t, _ in want if t not in (" er ", "ABC"))


def test_coordinate_files(spark, tmp_path):
    for name, body in {"p_min0_A_b_seed_1.csv": 'Row.names,Pseudotime\n"x-1-A_b",2\ny-A_b,\n', "p_min0_C_d_seed_1.csv": "Row.names,Pseudotime\nz-C_d,0\n", "none.csv": "Row.names,Pseudotime\nw,3\n"}.items():
        (tmp_path / name).write_text(body)
    got = files.coordinates(spark, str(tmp_path), base=str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("A_b", "x-1", 2.0, "p_min0_A_b_seed_1.csv")]
    assert files.coordinates(spark, str(tmp_path), name_part="C_d").count() == 0
    with pytest.raises(ValueError):
        files.coordinates(spark, str(tmp_path), strict=True)
    assert files.row_name_column(["_c0", "a"]) == "a" and files.row_name_column(["a", "b"]) == "a"


def test_whole_ranking(spark, tmp_path):
    coordinates = spark.createDataFrame([("Alpha_beta", "x-acid", 0.0), ("Alpha_beta", "y-acid", 5.0), ("Alpha_beta", "z-acid", 9.0), ("Alpha_beta", "w-acid", None)], "src string, mid string, value double")
    nodes = spark.createDataFrame([("alpha_beta", "Alpha beta", "source"), ("x_acid", "x-acid", "mid"), ("way", None, "other")], "id string, label string, type string")
    edges = spark.createDataFrame([("alpha_beta", "way", "r"), ("way", "x_acid", "s")], "source string, target string, relation string")
    texts_ = ["Alpha beta made x-acid in colitis mice", "Alpha beta way x-acid colitis mice", "ALPHA BETA, y-acid; colitis mice", "alpha beta and x-acid", "", None]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    known = spark.createDataFrame([("alpha beta strain", "Y acid")], "a string, b string")
    tables = ranking.run(coordinates, nodes, edges, docs, "colitis", ["mice"], str(tmp_path / "run"), {"known": ranking.Reference("source_mid", known, "a", "b")})
    got = {r["mid"]: r for r in tables["quadrants"].collect()}
    assert set(got) == {"x-acid", "y-acid", "z-acid"}
    assert [got[m]["signal"] for m in ("x-acid", "z-acid", "y-acid")] == [1.0, 0.6667, 0.3333]
    x, y, z = got["x-acid"], got["y-acid"], got["z-acid"]
    assert (x["path"], x["terms"], x["has_path"], y["has_path"]) == ("alpha_beta -[r]-> way -[s]-> x_acid", ["Alpha beta", "way", "x-acid"], True, False)
    assert (x["pair_sm"], x["chain_count"], y["chain_count"], z["chain_count"]) == (3, 2, 1, 0)
    assert (x["full_chain"], x["bottleneck"]["n"], y["full_chain"]) == (1, 1, None)
    assert x["novelty"] == pytest.approx(0) and y["novelty"] == pytest.approx(1 - math.log(2) / math.log(3)) and z["novelty"] == 1
    assert (x["quadrant"], y["quadrant"], z["quadrant"]) == ("III", "II", "II")
    assert {r["cand"]: (r["db_bonus"], r["chain_count"]) for r in tables["evidence"].collect()} == {x["cand"]: (0, 2), y["cand"]: (10, 11), z["cand"]: (0, 0)}
    empty = ranking.run(coordinates.limit(0), nodes, edges, docs, "colitis", ["mice"], out=str(tmp_path / "run"))
    assert empty["quadrants"].count() == 0


def test_gates_of_a_chain_of_sixty_levels_and_a_cycle(spark):
    n = 60
    names_ = [*map(str, range(n)), "p", "q"]
    modules = spark.createDataFrame([("c", i, "positive", "ready", "all_of") for i in names_], "plan string, module_id string, result_status string, design_status string, operator string")
    needs = [(str(i), str(i - 1)) for i in range(1, n)] + [("p", "q"), ("q", "p")]
    clauses = spark.createDataFrame([("c", i, j, None, ["positive"]) for i, j in needs], "plan string, module_id string, needs string, gate string, accepted array<string>")
    external = spark.createDataFrame([], "plan string, gate string, result_status string")
    got = {r["module_id"]: r["gate_status"] for r in gates.evaluated(modules, clauses, external).collect()}
    assert got == {i: "unknown" if i in "pq" else "met" for i in names_}


GATE_TABLES = ("plan string, module_id string, result_status string, design_status string, operator string", "plan string, module_id string, needs string, gate string, accepted array<string>", "plan string, gate string, result_status string")


def test_gates_of_a_chain_of_a_thousand_modules_take_few_rounds(spark, monkeypatch):
    rounds = []
    real = gates.kept
    monkeypatch.setattr(gates, "kept", lambda df, name: rounds.append(name) or real(df, name))
    n = 1000
    modules = [("c", str(i), "positive", "ready", "any_of" if i % 3 else "all_of") for i in range(n)]
    clauses = [("c", str(i), str(i - 1), None, ["positive"]) for i in range(1, n)] + [("c", "0", None, "board", ["positive"])]
    out = gates.evaluated(*(spark.createDataFrame(rows, schema) for rows, schema in zip((modules, clauses, []), GATE_TABLES)))
    assert {r["gate_status"] for r in out.collect()} == {"unmet"} and out.count() == n
    assert len(rounds) <= 12


@pytest.mark.parametrize("seed", range(3))
def test_gates_with_cycles_against_plain_recursion(spark, seed):
    r = random.Random(seed)
    modules, clauses = {}, {}
    for plan in range(12):
        size = r.randrange(1, 9)
        for i in range(size):
            key = (f"p{plan}", str(i))
            modules[key] = (r.choice(["positive", "positive", "positive", "negative"]), r.choice(["ready", "ready", "ready", "incomplete"]), r.choice(["all_of", "any_of"]))
            aims = [(str(r.randrange(size + 1)), None) if r.random() < 0.85 else (None, r.choice(["on", "off"])) for _ in range(r.choice([0, 1, 1, 1, 2, 3]))]
            clauses[key] = aims
    external = {"on": "positive", "off": "negative"}
    designs = {v: one(spark, names.design_status(F.lit(v)))[0] for v in ("ready", "incomplete")}

    def settled(key, seen):
        found = []
        for needs, gate in clauses[key]:
            if gate:
                found.append("met" if external[gate] == "positive" else "unmet")
                continue
            aim = (key[0], needs)
            if aim in seen or aim not in modules:
                found.append("unknown")
            elif modules[aim][0] != "positive" or designs[modules[aim][1]] == "needs_resolution":
                found.append("unmet")
            else:
                found.append(settled(aim, seen | {aim}))
        if not found or (modules[key][2] == "any_of" and "met" in found) or set(found) == {"met"}:
            return "met"
        return "unmet" if "unmet" in found else "unknown"

    rows = [[(*k, *v) for k, v in modules.items()], [(*k, needs, gate, ["positive"]) for k, aims in clauses.items() for needs, gate in aims], [(p, g, v) for p in {k[0] for k in modules} for g, v in external.items()]]
    out = gates.evaluated(*(spark.createDataFrame(x, schema) for x, schema in zip(rows, GATE_TABLES))).collect()
    assert {(x["plan"], x["module_id"]): x["gate_status"] for x in out} == {k: settled(k, frozenset()) for k in modules} and len(out) == len(modules)


def test_ordering_of_a_chain_of_sixty_hops(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1), 1.0) for i in range(60)] + [("60", "lost", None)], "a string, b string, length double")
    got = {r["id"]: r["distance"] for r in compose.ordering(edges, spark.createDataFrame([("0",)], "id string")).collect()}
    assert got == {str(i): float(i) for i in range(61)}
    with pytest.raises(ValueError):
        compose.ordering(spark.createDataFrame([("0", "1", -1.0)], "a string, b string, length double"), spark.createDataFrame([("0",)], "id string"))


def test_index_gives_what_comparing_everything_gives_and_visits_little(spark):
    import numpy as np

    from rankweave.operators import embed

    r = np.random.default_rng(3)
    middle = r.normal(0, 1, (40, 24))
    v = middle[r.integers(0, 40, 6000)] + r.normal(0, 0.08, (6000, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, "a" if i % 5 else "b", x.tolist()) for i, x in enumerate(v)] + [(6000, "b", v[0].tolist()), (6001, None, v[1].tolist()), (6002, "lone", v[2].tolist())]
    df = spark.createDataFrame(rows, "id long, type string, vector array<double>").repartition(5)
    q = df.filter("id % 3 = 0 OR id > 5999").withColumnRenamed("id", "qid").unionByName(spark.createDataFrame([(9000, "unknown", v[3].tolist())], "qid long, type string, vector array<double>"))
    got, visited = embed.search(q, embed.Index(df), 7, 0.3)
    plain = {(x["qid"], x["id"], x["rank"]): x["score"] for x in embed.top_k(q, df, 7, 0.3).collect()}
    mine = {(x["qid"], x["id"], x["rank"]): x["score"] for x in got.collect()}
    assert mine.keys() == plain.keys() and all(abs(mine[k] - plain[k]) < 1e-12 for k in plain)
    work = visited.filter("blocks > 0").agg(F.sum("visited").alias("v"), F.sum("blocks").alias("b")).first()
    assert work["v"] / work["b"] < 0.3
    assert embed.search(q, embed.Index(df.limit(0)), 7, 0.3)[0].collect() == []


def test_search_sends_no_vector_once_for_each_block_visited(spark, monkeypatch):
    from rankweave.operators import embed

    v = np.random.default_rng(8).normal(0, 1, (3000, 16))  # without structure: nearly all blocks are visited
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], x.tolist()) for i, x in enumerate(v)], "id long, type string, vector array<double>")
    rows, kept = [], embed.kept

    def counted(table, name, *more, **after):
        out = kept(table, name, *more, **after)
        rows.append(out.count() if "vector" in out.columns else 0)
        return out

    monkeypatch.setattr(embed, "kept", counted)
    for name, n in (("GROUP", 200), ("MOST", 300), ("CHUNK", 500)):
        monkeypatch.setattr(embed, name, n, raising=False)
    got, visited = embed.search(df.withColumnRenamed("id", "qid"), embed.Index(df), 5, 0.1)
    plain = {(x["qid"], x["id"], x["rank"]): x["score"] for x in embed.top_k(df.withColumnRenamed("id", "qid"), df, 5, 0.1).collect()}
    mine = {(x["qid"], x["id"], x["rank"]): x["score"] for x in got.collect()}
    assert mine.keys() == plain.keys() and all(abs(mine[k] - plain[k]) < 1e-12 for k in plain)
    assert visited.agg(F.sum("visited")).first()[0] > 10 * 3000
    assert max(rows) <= embed.FIRST * 3000


def test_neighbour_graph_and_bands_against_plain_search(spark):
    import heapq

    from rankweave.operators import embed

    r = random.Random(6)
    points = [(i, "ab"[i % 4 == 0], [r.random() * 10, r.choice([0.0, 0.5, 3.0])]) for i in range(160)] + [(500 + i, "a", [5.0, 5.0]) for i in range(9)]
    edges = embed.neighbour_graph(spark.createDataFrame(points, "id long, type string, vector array<double>"), 3)
    got = {(x["a"], x["b"]): x["length"] for x in edges.collect()}
    want = {}
    for i, t, p in points:
        near = sorted((math.dist(p, q), j) for j, u, q in points if u == t and j != i)[:3]
        want |= {(i, j): d for d, j in near}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    around, best = {}, {}
    for (a, b), d in want.items():
        around.setdefault(a, []).append((d, b))
        around.setdefault(b, []).append((d, a))
    heap = [(0.0, 0), (0.0, 1)]
    while heap:
        d, i = heapq.heappop(heap)
        if i not in best:
            best[i] = d
            for step, j in around[i]:
                heapq.heappush(heap, (d + step, j))
    for width in (None, 0.4):
        found = {x["id"]: x["distance"] for x in compose.ordering(edges, spark.createDataFrame([(0,), (1,)], "id long"), width).collect()}
        assert found.keys() == best.keys() and all(found[k] == pytest.approx(best[k]) for k in best)


@pytest.mark.parametrize("alternative", ["greater", "two-sided"])
def test_exact_rank_sums_against_all_signs(spark, alternative):
    rows = [("a", d) for d in (0.5, -0.1, 2.0, 3.5, -1.25, 0.75, 4.0, 0.2)] + [("tied", d) for d in (1.0, -1.0, 2.0)] + [("zero", d) for d in (0.0, 1.0, 3.0)] + [("none", 0.0)]
    got = {r["method"]: r for r in benchstat.wilcoxon(benchstat.signed_ranks(spark.createDataFrame(rows, "method string, diff double"), "method"), alternative).collect()}
    own = [d for m, d in rows if m == "a"]
    rank = {abs(d): k for k, d in enumerate(sorted(own, key=abs), 1)}
    w = sum(rank[abs(d)] for d in own if d > 0)
    sums = [sum(k for k, up in zip(range(1, 9), signs) if up) for signs in itertools.product((0, 1), repeat=8)]
    above, below = sum(x >= w for x in sums) / 256, sum(x <= w for x in sums) / 256
    assert got["a"]["p_value"] == pytest.approx(above if alternative == "greater" else min(1, 2 * min(above, below)))
    assert got["none"]["p_value"] == 1 and got["none"]["statistic"] == 0
    for m in ("tied", "zero"):  # these take the normal approximation
        z = got[m]["z"] if alternative == "greater" else abs(got[m]["z"])
        assert got[m]["p_value"] == pytest.approx(min(1, 0.5 * math.erfc(z / math.sqrt(2)) * (1 if alternative == "greater" else 2)))


def test_ranks_and_medians_over_many_tasks(spark, monkeypatch):
    from rankweave.operators import ordered

    r = random.Random(8)
    rows = [("hot" if i % 3 else None if i % 7 == 0 else f"k{i % 7}", round(r.gauss(0, 50), r.choice([0, 6])), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(7)
    got = {x["i"]: x["nth"] for x in ordered.ranked(df, ["k"], [F.desc("v"), "i"], "nth").collect()}
    for k in {x[0] for x in rows}:
        order = sorted((x for x in rows if x[0] == k), key=lambda x: (-x[1], x[2]))
        assert [got[x[2]] for x in order] == list(range(1, len(order) + 1))
    monkeypatch.setattr(ordered, "FEW", 10)
    monkeypatch.setattr(ordered, "GRID", 20)
    for some in (rows, rows[:1], [("a", 5.0, i) for i in range(100)], [("a", float(i > 30), i) for i in range(61)], [("a", 10.0 ** (i % 300), i) for i in range(500)]):
        want = statistics.median(x[1] for x in some)
        assert ordered.median(spark.createDataFrame(some, "k string, v double, i int"), "v") == want
    assert ordered.median(df.filter("false"), "v") is None


def test_quantiles_of_whole_columns_need_no_joins(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW", 10)
    monkeypatch.setattr(ordered, "AT_MOST", 20)
    monkeypatch.setattr(ordered, "FINE", 50)  # bounds far apart, so that several passes are needed
    monkeypatch.setattr(ordered, "_narrowed", None)
    r = random.Random(5)
    rows = [(r.choice([-0.0, 0.0, 1.0, r.gauss(0, 9)]), r.choice([math.inf, -math.inf, math.nan, r.random()]), r.random() if i < 5 else None) for i in range(1501)]
    got = {(x["column"], x["fraction"]): x["value"] for x in ordered.quantiles(spark.createDataFrame(rows, "v double, w double, few double"), ["v", "w", "few"], [0.0, 0.2, 0.5, 0.77, 1.0]).collect()}
    assert len(got) == 15
    for i, c in enumerate(("v", "w", "few")):
        xs = sorted((x[i] for x in rows if x[i] is not None), key=lambda x: (math.isnan(x), x))
        for f in (0.0, 0.2, 0.5, 0.77, 1.0):
            at = (len(xs) - 1) * f
            lo, hi = xs[int(at)], xs[min(int(at) + 1, len(xs) - 1)]
            want = lo if at == int(at) or lo == hi else lo + (hi - lo) * (at - int(at))
            assert got[c, f] == pytest.approx(want, nan_ok=True)


def test_signal_of_sources_that_fit_a_task_and_of_larger_ones(spark, monkeypatch):
    r = random.Random(6)
    df = spark.createDataFrame([(r.choice(["a", "b", None]), f"m{i}", float(r.randrange(20))) for i in range(300)], "src string, mid string, value double")
    got = lambda: sorted(map(str, signal.dual_end_signal(df).collect()))
    monkeypatch.setattr(signal, "ONE_TASK", 0)
    want = got()
    monkeypatch.setattr(signal, "ONE_TASK", 1000)
    monkeypatch.setattr(signal, "ranked", None)  # none of them is sorted by range
    assert got() == want and len(want) == 300


def test_among_first_marks_the_first_of_each_group(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i, float(i % 5)) for i in range(30)], "g string, id int, v double")
    got = {x["id"] for x in ordered.among_first(df, ["g"], [F.desc("v"), "id"], ["id"], 4, "top").collect() if x["top"]}
    assert got == {4, 14, 19, 29, 9, 24, 3, 18}
    assert ordered.among_first(df, ["g"], ["id"], ["id"], 4, "top").count() == 30


def test_quantiles_of_many_groups_with_ties_infinities_and_nan(spark):
    import duckdb

    from rankweave.operators import ordered

    df = spark.range(130_000).select(
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 1001 == 1, None).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("k"),
        F.when(F.col("id") == 5, F.lit(float("inf"))).when(F.col("id") == 6, F.lit(-float("inf"))).when(F.col("id") == 8, F.lit(float("nan"))).when(F.col("id") % 4 == 0, F.lit(3.0)).otherwise(F.sin(F.col("id") * 0.37) ** 3 * 1e6).alias("v"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("w"),
    )
    table = df.toPandas()
    duck = duckdb.connect()
    duck.register("t", table)
    table["w"] = table["w"].astype("Float64")
    got = {(r["k"], r["column"], r["fraction"]): r["value"] for r in ordered.quantiles(df, ["v", "w"], [0.0, 0.25, 0.5, 0.9], ["k"]).collect()}
    groups = table.assign(k=table.k.fillna("")).groupby("k")
    for k, g in groups:
        for c in ("v", "w"):
            values = sorted((float(x) for x in g[c].dropna()) if c == "w" else [x for x in g[c] if x == x] + [float("nan")] * int(sum(x != x for x in g[c])), key=lambda x: (x != x, x))
            for p in (0.0, 0.25, 0.5, 0.9):
                at = (len(values) - 1) * p
                x, y = values[math.floor(at)], values[math.ceil(at)]
                assert got[k or None, c, p] == pytest.approx(x if x == y else x + (y - x) * (at - math.floor(at)), rel=1e-12), (k, c, p)


def test_mean_ranks_of_a_large_group_with_ties(spark):
    from rankweave.operators import ordered

    r = random.Random(4)
    rows = [("hot" if i % 2 else r.choice(["a", "b", None]), r.choice([0.0, -0.0, 1.5, None, float("nan"), float("-inf"), r.random()]), i) for i in range(3000)]
    out = ordered.mean_ranked(spark.createDataFrame(rows, "k string, v double, i int").repartition(6), ["k"], F.col("v")).collect()
    key = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    for k in ("hot", "a", "b", None):
        order = sorted(key(x[1]) for x in rows if x[0] == k)
        first, last = {}, {}
        for at, v in enumerate(order, 1):
            first.setdefault(v, at)
            last[v] = at
        own = [x for x in out if x["k"] == k]
        assert len(own) == len(order)
        assert all(x["rank"] == (first[key(x["v"])] + last[key(x["v"])]) / 2 for x in own)


def test_protocols_at_any_depth(spark):
    deep = '{"id": 1, "steps": [{"description": "<p>Mix</p>", "components": [{"source": {"amount": "2 ml", "unit": "ml", "inner": [{"Temperature": 37.5}]}}, {"name": "MIX"}]}, {"note": "no text"}, {"cases": [[{"value": 3}]]}], "materials": [{"name": "tube", "vendor": {"name": "V"}, "sku": ""}, {"name": "Tube | vendor: V"}]}'
    rows = spark.createDataFrame([(deep,), ("not json",), (None,), ('{"id": 2, "steps": {"text": "no list"}}',)], "j string")
    got = {r["id"]: r for r in files.protocols(rows, "j").collect()}
    assert got["1"]["steps"] == ["Step 1: Mix | 2 ml | 37.5", "Step 3: 3"] and got["1"]["materials"] == ["tube | vendor: V"]
    assert got["2"]["steps"] == []


def test_protocols_are_ranked_by_the_last_of_each_key(spark):
    rows = [("a", 1, "old colitis", "", None, False), ("b", 2, "mice", "", "10.1/x", True), ("a", 3, "new", "dss and mice", None, False), ("", 4, "mice", "", None, False), ("c", 5, "tea", "", None, False), ("d", 6, "mice", "", "10.1/y", True)]
    items = spark.createDataFrame(rows, "id string, at int, title string, body string, doi string, peer_reviewed boolean")
    got = [(r["id"], r["score"], r["models"]) for r in articles.ranked_protocols(items, "id", "at", ["mice", "dss", "te"]).orderBy("nth").collect()]
    assert got == [("b", 5, ["in_vivo"]), ("d", 5, ["in_vivo"]), ("a", 4, ["in_vivo"])]


@pytest.mark.parametrize("first", [True, False])
def test_pair_fallback_against_all_combinations_in_order(spark, first):
    r = random.Random(4)
    words = ["ab", "bc", "cd", "abc", "xyz", "q", "bcd", "zz"]
    table = [(i, r.choice([*words, None, ""]), r.choice([*words, None])) for i in range(60)]
    pairs = sorted({(r.choice(["ab", "xyz", "k1", "k2", "k3"]), r.choice(["q", "w1", "w2", "w3"])) for _ in range(14)}) + [("k1", None)]
    near = {k: [r.choice([*words, "none"]) for _ in range(3)] for k in ("ab", "xyz", "k1", "k2", "k3", "q", "w1", "w2", "w3")}
    groups = {"w1": ["bcd"], "none": ["zz"]}
    fits = lambda x, y: bool(x and y) and (x in y or y in x)
    fits_b = lambda x, y: any(fits(f, y) for f in [x, *groups.get(x, [])])
    want = set()
    for a, b in pairs:
        rows = lambda fa, fb: {i for i, x, y in table if fits(fa, x) and fits_b(fb, y)}
        if direct := rows(a, b):
            want |= {(a, b, i, "direct") for i in direct}
        elif first:
            for fa, fb in itertools.product([a, *near[a]], [b, *near.get(b, [])]):
                if hit := rows(fa, fb):
                    want |= {(a, b, i, "neighbour") for i in hit}
                    break
        else:
            want |= {(a, b, i, "neighbour") for fa in near[a] for fb in near.get(b, []) for i in rows(fa, fb)}
    of = spark.createDataFrame([(q, k + 1, n) for q, ns in near.items() for k, n in enumerate(ns)], "query string, rank int, neighbour string")
    df = spark.createDataFrame(table, "row int, x string, y string")
    got = refmatch.pairs_with_fallback(spark.createDataFrame(pairs, "a string, b string"), of, of, df, "a", "b", "x", "y", groups, first).collect()
    assert sorted((g["a"], g["b"], g["row"], g["method"]) for g in got) == sorted(want)
    assert {g["method"] for g in got} == {"direct", "neighbour"}


@pytest.mark.parametrize("scaled", [False, True])
def test_components_of_5000_samples_against_a_dense_decomposition(spark, scaled):
    r = np.random.default_rng(1)
    a = (r.normal(size=(60, 4)) * [50, 30, 20, 10]) @ r.normal(size=(4, 5000)) * 0.1 + r.normal(size=(60, 5000)) * (r.random((60, 5000)) < 0.02)
    a = np.where(r.random(a.shape) < 0.3, a, 0)
    a[:, 7] = 0
    i, j = np.nonzero(a)
    df = spark.createDataFrame([(f"p{x}", f"s{y}", float(a[x, y])) for x, y in zip(i, j)], "value string, mean string, v double")  # names that the operator uses itself
    found = spectral.components(df, 3, "value", "mean", "v", scaled=scaled)
    got = {x["value"]: x["pc"] for x in found.scores.collect()}
    b = a - a.mean(0)
    if scaled:
        b /= np.where(b.std(0, ddof=1) > 0, b.std(0, ddof=1), 1)
    u, s, vt = np.linalg.svd(b, full_matrices=False)
    sign = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(1)])  # the largest loading is positive
    assert np.abs(np.array([got[f"p{x}"] for x in range(60)]) - u[:, :3] * s[:3] * sign).max() < 1e-5 * s[0]
    loaded = {x["mean"]: x["pc"] for x in found.loadings.collect()}
    assert max(abs(loaded[f"s{y}"][0] - vt[0, y] * sign[0]) for y in set(j.tolist())) < 1e-5
    assert np.allclose(found.variances, s[:3] ** 2 / 59) and np.isclose(found.total, (s**2).sum() / 59)
    assert found.rounds < 20


@pytest.mark.parametrize("shape", [(120, 900), (900, 120)])
def test_components_without_leading_directions_take_few_passes(spark, shape):
    r = np.random.default_rng(2)
    a = np.where(r.random(shape) < 0.2, r.normal(size=shape) + 3, 0)
    a /= a.sum(0) / 10 if shape[0] < shape[1] else 1  # the first directions are hardly longer than the next
    i, j = np.nonzero(a)
    df = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "pair long, sample long, score double")
    found = spectral.components(df, 2, most_error=1e-9)
    b = a - a.mean(0)
    u, s, vt = np.linalg.svd(b, full_matrices=False)
    sign = np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(1)])
    got = {x["pair"]: x["pc"] for x in found.scores.collect()}
    assert np.abs(np.array([got[x] for x in range(shape[0])]) - u[:, :2] * s[:2] * sign).max() < 1e-6 * s[0]
    loaded = {x["sample"]: x["pc"] for x in found.loadings.collect()}
    assert max(np.abs(loaded[y] - vt[:2, y] * sign).max() for y in range(shape[1])) < 1e-6
    assert np.allclose(found.variances, s[:2] ** 2 / (shape[0] - 1))
    assert found.rounds <= 8


def test_components_of_a_longer_side_hold_fewer_columns(spark, monkeypatch):
    r = np.random.default_rng(4)
    a = (r.normal(size=(120, 3)) * [9, 5, 2]) @ r.normal(size=(3, 300)) + r.normal(size=(120, 300))
    df = spark.createDataFrame([(x, y, float(a[x, y])) for x in range(120) for y in range(300)], "pair long, sample long, score double")
    widths, passes = [], spectral._passes
    monkeypatch.setattr(spectral, "_passes", lambda lists, size, u, shift: widths.append(u.shape[1]) or passes(lists, size, u, shift))
    monkeypatch.setattr(spectral, "HELD", 120 * 20)
    found = spectral.components(df, 2, most_error=1e-9)
    b = a - a.mean(0)
    u, s, vt = np.linalg.svd(b, full_matrices=False)
    sign = np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(1)])
    got = {x["pair"]: x["pc"] for x in found.scores.collect()}
    assert np.abs(np.array([got[x] for x in range(120)]) - u[:, :2] * s[:2] * sign).max() < 1e-6 * s[0]
    assert max(widths) == 6 and len(widths) > 3  # three blocks and more: the basis of 20 columns was cut back


def test_components_of_17000_rows_join_no_entries(spark, monkeypatch):
    n = 17_000
    row = np.repeat(np.arange(n), 2)
    column, value = row.copy(), np.ones(2 * n)
    column[1::2], value[1::2] = n + row[1::2] % 3, 1.0 + 4 * (row[1::2] % 3)
    df = spark.createDataFrame(pa.table({"pair": row, "sample": column, "score": value}))
    monkeypatch.setattr(spectral, "_applied", None)  # it joins the entries twice a round
    found = spectral.components(df, 1, most_error=1e-9)
    v = np.sin(np.arange(n + 3.0))
    for _ in range(200):
        y = np.bincount(row, value * v[column])
        v = np.bincount(column, value * (y - y.mean())[row])
        v /= np.linalg.norm(v)
    y = np.bincount(row, value * v[column])
    y = (y - y.mean()) * np.sign(v[np.abs(v).argmax()])
    got = {x["pair"]: x["pc"][0] for x in found.scores.collect()}
    assert np.abs(np.array([got[i] for i in range(n)]) - y).max() < 1e-6 * np.linalg.norm(y)


def test_components_with_both_sides_long(spark, monkeypatch):
    monkeypatch.setattr(spectral, "NARROW", 0)
    test_components_of_5000_samples_against_a_dense_decomposition(spark, True)
    test_components_of_small_and_odd_matrices(spark)


def test_protocols_of_one_file_are_the_work_of_many_tasks(spark, tmp_path):
    rows = [(f'{{"id": "{i}", "steps": [{{"text": "do {i}"}}], "materials": []}}',) for i in range(200)]
    spark.createDataFrame(rows, "j string").coalesce(1).write.parquet(str(tmp_path / "p"))
    out = files.protocols(spark.read.parquet(str(tmp_path / "p")), "j")
    assert out.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 8
    assert {x["id"]: x["steps"] for x in out.collect()} == {str(i): [f"Step 1: do {i}"] for i in range(200)}


def test_promising_blocks_are_those_of_a_sort(spark):
    r = np.random.default_rng(3)
    for k in (1, 6, 40, 10_000):
        gap, to, n = r.integers(-1, 4, (50, 30)).astype(float), r.random((50, 30)), r.integers(1, 20, 30)
        order = np.lexsort((to, gap), axis=1)
        count = np.minimum(np.maximum((np.cumsum(n[order], axis=1) < k).sum(1) + 1, embed.FIRST), 30)
        want = [set(o[:c].tolist()) for o, c in zip(order, count)]
        assert [set(np.flatnonzero(x).tolist()) for x in embed._promising(gap, to, n, k)] == want


def test_vectors_of_one_file_are_the_work_of_many_tasks(spark, tmp_path):
    spark.range(400).selectExpr("id", "'t' AS type", "array(double(id), 0D) AS vector").coalesce(1).write.parquet(str(tmp_path / "v"))
    index = embed.Index(spark.read.parquet(str(tmp_path / "v")), "euclidean")
    queries = index.rows.selectExpr("id AS qid", "'t' AS type", "vector")
    found = embed.search(queries, index, 2, -float("inf"))[0]
    assert found.count() == 800
    assert len(index.source.inputFiles()) >= 8


def test_components_of_small_and_odd_matrices(spark):
    of = lambda rows: spectral.components(spark.createDataFrame(rows, "pair string, sample string, score double"), 2)
    empty = of([])
    assert empty.scores.count() == 0 and empty.variances == []
    one = of([("a", "x", 1.0), ("a", "y", 2.0)])
    assert [tuple(r) for r in one.scores.collect()] == [("a", [])] and one.total == 0
    line = of([("a", "x", 1.0), ("b", "x", 1.0), ("b", "x", 1.0), ("c", "x", None), (None, "x", 9.0), ("c", None, 9.0)])  # 1, 2, 0
    assert sorted((r["pair"], round(r["pc"][0], 9)) for r in line.scores.collect()) == [("a", 0.0), ("b", 1.0), ("c", -1.0)]
    assert np.allclose(line.variances, [1.0])
    with pytest.raises(ValueError):
        of([("a", "x", math.inf)])


def test_audit_lists_in_normal_form(spark):
    item = '{"claim": " a\\n", "support_level": " STRONG ", "pmids": [" 1 ", 2, "", null], "reason": 0}'
    rows = [
        (f"[{item}, 5, null, {{}}]", [("a", "strong", ["1", "2"], ""), ("", "speculative", [], "")]),
        ("[" + ", ".join(['"x"'] * 11 + [item] * 3) + "]", [("a", "strong", ["1", "2"], "")]),  # the first twelve count, objects or not
        ('[{"claim": false, "support_level": "  ", "pmids": "7"}, {"claim": [1], "support_level": 2, "reason": "0"}]', [("", "", [], ""), ("[1]", "2", [], "0")]),
        ('{"claim": "a"}', []), ("no json", []), ("", []), (None, []), ("[]", []),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, json string")
    got = {r["i"]: [(x["claim"], x["support_level"], x["pmids"], x["reason"]) for x in r["x"]] for r in df.select("i", audits.normal_items(F.col("json"), "claims", True).alias("x")).collect()}
    assert got == {i: r[1] for i, r in enumerate(rows)}
    log = spark.createDataFrame([('[{"round": "3", "pmid_count": -2.9, "article_count": [1], "label": 0.0}]',)], "json string").select(audits.normal_items(F.col("json"), "queries").alias("x")).first()["x"]
    assert [tuple(x) for x in log] == [(3, "", "", "", -2, 0)]
    for kind, most in (("evidence", 14), ("reflections", 10), ("strengths", 10)):
        many = spark.createDataFrame([("[" + ",".join(["{}"] * 20) + "]",)], "json string").select(audits.normal_items(F.col("json"), kind).alias("x")).first()["x"]
        assert len(many) == most
    audit = spark.createDataFrame([(f'{{"overall_assessment": " ok ", "supported_claims": [{item}], "priority_gaps": ["g", " "]}}',), ("[1]",), (None,)], "json string")
    a, *nothing = [r["a"] for r in audit.select(audits.normal_audit(F.col("json")).alias("a")).collect()]
    assert (a["overall_assessment"], [tuple(x) for x in a["supported_claims"]], a["inference_only_claims"], a["priority_gaps"]) == ("ok", [("a", "strong", ["1", "2"])], [], ["g"])
    assert all(tuple(x) == ("", [], [], [], []) for x in nothing)


def test_names_either_way_are_a_table(spark):
    """What uses the pairs reads them: plans that carry all of its joins, times over, fill the driver's memory."""
    one, two = (spark.createDataFrame([(x,) for x in names], f"{c} string") for c, names in (("a", ["ab", "b", "cabin", "", "zz"]), ("b", ["cab", "b", "in a cabin", "x", ""])))
    pairs = refmatch.either_way(one, two, "a", "b")
    assert {tuple(r) for r in pairs.collect()} == {("ab", "cab"), ("ab", "b"), ("ab", "in a cabin"), ("b", "cab"), ("b", "b"), ("b", "in a cabin"), ("cabin", "cab"), ("cabin", "b"), ("cabin", "in a cabin")}
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_texts_stay_in_their_rows_until_few_sentences_are_left(spark):
    src, mid, dst = ["Alpha beta", "A. beta"], ["gamma acid"], ["colitis"]
    plain = "Nothing is said. " * 300
    texts_ = [plain + "In pure culture A. beta was grown and produced gamma acid, as measured. " + plain, plain + "Alpha beta is here. " + plain + "Gamma acid is there. " + plain, plain, None]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id int, text string")
    got = articles.windowed_signals(df, src, mid, dst)
    assert {r["doc_id"]: r["direct_monoculture_production"] for r in got.collect()} == {0: True}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_list_is_made_once_before_its_repeats_go(spark):
    made = names.distinct_in_order(F.split("id", "-"))
    assert [one(spark, names.distinct_in_order(F.array(*map(F.lit, x))))[0] for x in (["a ", "A", "", "b", "a"], [""])] == [["a", "b"], []]
    assert str(made).count("split") == 1


def test_cosines_that_are_equal_but_for_rounding_go_by_id(spark):
    from rankweave.operators import embed

    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 64))
    base += 2 * base[0]
    vectors = [(int(i), "t", [float(x) for x in base[i // 4] * (1.0, 3.0, 0.7, 1.9)[i % 4]]) for i in range(24)]  # four of each direction
    df = embed.unit(spark.createDataFrame(vectors, "id long, type string, vector array<double>"), "vector")
    q = df.withColumnRenamed("id", "qid")
    for found in (embed.top_k(q, df, 24, -1.0), embed.search(q, embed.Index(df), 24, -1.0)[0]):
        of = {}
        for r in sorted(found.collect(), key=lambda r: (r["qid"], r["rank"])):
            of.setdefault(r["qid"], []).append(r["id"])
        assert len(of) == 24 and all(ids[i : i + 4] == sorted(ids[i : i + 4]) and len({x // 4 for x in ids[i : i + 4]}) == 1 for ids in of.values() for i in range(0, 24, 4))


def test_counts_of_candidates_are_plans_of_few_joins(spark, monkeypatch):
    joins, kept = [], corpus.kept
    of = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    monkeypatch.setattr(corpus, "kept", lambda df, *more, **after: joins.append(of(df)) or kept(df, *more, **after))
    held = spark.createDataFrame([(d, t, d % 2 == 0) for d in range(6) for t in "abc" if (d + ord(t)) % 3], "doc_id long, term string, exp boolean")
    out = corpus.counts(spark.createDataFrame([("1", "a", "b", "c")], "cand string, src string, mid string, dst string"), held)
    assert [tuple(r) for r in out.collect()] == [("1", 2, 0, 2, 2, 1, 0, 1)]
    assert max(joins + [of(out)]) <= 6


def test_the_beginnings_of_documents_are_passages_too(spark):
    from rankweave.plans import ORACLES

    assert "left(text, 60)" in ORACLES["FL14_methods_passages"]


def test_first_articles_are_chosen_before_their_texts_move(spark):
    from rankweave.plans import QUERIES

    plan = QUERIES["TX6_evidence_facets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_rows_of_a_file_stay_in_their_tasks(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", -2.0), ("a", None), ("b", 0.0), ("b", -1.0), (None, 3.0), ("c", math.nan)], "file string, value double")
    got = signal.usable(rows, file="file")
    assert sorted((r["file"] or "", r["value"]) for r in got.collect()) == [("", 3.0), ("a", -2.0), ("a", 1.0)] and got.columns == ["file", "value"]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_are_counted_within_their_source_and_no_row_is_made_of_each(spark):
    rows = [("a", [(2, "cosine"), (2, "cosine"), (3, "cosine"), (2, "euclidean")]), ("b", [(5, None), (5, None)]), ("c", [])]
    df = spark.createDataFrame(rows, "src string, tasks array<struct<n: int, metric: string>>")
    out = compose.tasks_by_metric(df, "src")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("a", "cosine", 3, 2), ("a", "euclidean", 1, 1), ("b", None, 2, 1)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan


def test_normal_forms_of_gaps_are_made_once_a_text(spark):
    gaps = spark.createDataFrame([(1, "A thin  film."), (1, "Light"), (2, "A thin  film."), (3, None)], "k int, gap string")
    claims = spark.createDataFrame([(1, "A THIN film, here [PMID: 3]"), (2, "Other"), (2, "Other"), (3, None)], "k int, claim string")
    out = articles.open_gaps(gaps, claims, "k")
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "Light"), (2, "A thin  film."), (3, None)]
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_source_is_written_as_several_files(spark, tmp_path):
    import os

    from rankweave.plans import grading
    from rankweave.plans.registry import Tables

    spark.range(40_000).selectExpr("id AS l_partkey", "1L AS l_suppkey", "1.5D + id AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1, 2).selectExpr("id AS s_suppkey", "7 AS s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = grading.coordinate_files(Tables(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    written = [f for d, _, names in os.walk(path) for f in names if f.endswith(".csv")]
    assert len(written) > 1 and files.coordinates(spark, path, strict=True).count() == 40_000
