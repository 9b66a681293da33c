"""Literature operators over a corpus table: which terms occur where, and what follows from it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts
from ..sources.shared import kept
from .ordered import each_slot, occupied, slot_of
from .quadrant import novelty_by_ceiling


#: Letters of all terms together up to which one automaton, sent to all tasks, finds them; beyond it terms and words are joined.
AUTOMATON = 2_000_000
#: Automata that a worker keeps from one task to the next.
_BUILT: dict[str, object] = {}


def _automaton(name: str, terms: Sequence[tuple[str, Sequence[str]]]):
    """An Aho-Corasick automaton that reports a term's number and length at its last letter; a worker builds it once."""
    import ahocorasick

    if name not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for i, (low, _) in enumerate(terms):
            made.add_word(low, (i, len(low)))
        made.make_automaton()
        _BUILT[name] = made
    return _BUILT[name]


def _terms_in(text: str, automaton) -> list[int]:
    """The numbers of the terms in a text, each once; up to three letters they must be whole words."""
    found, end = set(), len(text) - 1
    for last, (i, n) in automaton.iter(text):
        if i not in found and (n > 3 or not (last < end and text[last + 1].isalnum()) and not (last >= n and text[last - n].isalnum())):
            found.add(i)
    return sorted(found)


def incidence(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text", term: str = "term", flags: Sequence[str] = ()) -> DataFrame:
    """(doc, term, flags): each distinct term that a document holds, once.

    Terms of up to three letters must be whole words, longer ones may lie in a
    word; case doesn't matter, nor white space around a term.  Terms without a
    letter or digit, and null texts, are in nothing.  One pass over the
    documents runs an automaton of all terms, while these are few enough to be
    sent to all tasks (``AUTOMATON``); see ``joined_incidence`` for more.
    """
    t = terms.select(F.lower(F.trim(term)).alias("_low"), F.col(term).alias("_term")).filter(F.col("_low").rlike(r"[\p{L}\p{N}]")).distinct()
    t = kept(t.groupBy("_low").agg(F.sort_array(F.collect_list("_term")).alias("_terms")), "terms")
    if (t.agg(F.sum(F.length("_low") * F.size("_terms")).alias("n")).first()["n"] or 0) > AUTOMATON:
        return joined_incidence(docs, terms, doc, text, term, flags)
    known = [(r["_low"], r["_terms"]) for r in t.orderBy("_low").collect()]
    name, out = uuid.uuid4().hex, [doc, *flags]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, known)
        for batch in batches:
            row, held = [], []
            for at, value in enumerate(batch.column("_text")):
                for i in _terms_in(value.as_py() or "", automaton) if known else []:
                    row += [at] * len(known[i][1])
                    held += known[i][1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(row, pa.int64())) for c in out], pa.array(held, pa.string())], names=[*out, "_held"])

    rows = docs.select(*out, F.lower(text).alias("_text"))
    schema = T.StructType([*[rows.schema[c] for c in out], T.StructField("_held", T.StringType())])
    found = rows.mapInArrow(work, schema).withColumnRenamed("_held", term)
    return found.select(doc, term, *flags)


def joined_incidence(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text", term: str = "term", flags: Sequence[str] = ()) -> DataFrame:
    """What ``incidence`` gives, for any number of terms.

    The text's distinct words decide where a term can be at all; only those
    places are looked at.
    """
    low = docs.select(doc, *flags, F.lower(text).alias("_text"))
    words = low.select(doc, F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("_word"))
    t = terms.select(F.lower(F.trim(term)).alias("_term"), F.col(term)).distinct()
    t = t.withColumn("_key", F.regexp_extract("_term", r"([\p{L}\p{N}]+)", 1)).filter("_key != ''")
    from .refmatch import contained

    single = t.filter(F.col("_term").rlike(r"^[\p{L}\p{N}]+$"))
    inside = contained(single.filter(F.length("_term") > 3).select("_term").distinct(), words.select("_word").distinct(), "_term", "_word")
    whole = single.filter(F.length("_term") <= 3).select("_term", F.col("_term").alias("_word"))
    found = words.join(inside.unionByName(whole), "_word").join(single, "_term").select(doc, term).distinct()
    several = t.join(single.select(term), term, "left_anti")
    ends = contained(several.select("_key").distinct(), words.select("_word").distinct(), "_key", "_word")
    near = words.join(ends, "_word").select(doc, "_key").distinct().join(several, "_key").select(doc, term, "_term")
    more = near.join(low, doc).filter(F.contains("_text", F.col("_term"))).select(doc, term)
    out = found.unionByName(more).distinct()
    return out.join(low.select(doc, *flags), doc) if flags else out


def word_incidence(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text", term: str = "term") -> DataFrame:
    """(doc, term): each term of one word with the documents that hold it as a whole word."""
    words = docs.select(doc, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)))).alias(term))
    return words.join(terms.select(F.lower(term).alias(term)).distinct(), term).select(doc, term)


def experimental(text: Column, terms: Sequence[str]) -> Column:
    return F.coalesce(texts.any_of(text, terms), F.lit(False))


#: Sets of a candidate's terms that are counted together, and the names of the counts.
SETS = {"pair_sm": ["src", "mid"], "triple_smd": ["src", "mid", "dst"], "pair_sd": ["src", "dst"], "pair_md": ["mid", "dst"]}
FLAGGED = ["pair_sm", "triple_smd", "pair_md"]


def _spread(found: DataFrame, doc: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """(term, doc, ...) with a slot for each row, and (term, _n, _slots): a term's documents, counted, and the slots that they lie in."""
    spread = found.select("term", doc, *more).withColumn("_slot", slot_of(doc))
    parts = spread.groupBy("term", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    return spread, kept(parts.groupBy("term").agg(F.sum("_n").alias("_n"), occupied().alias("_slots")), "term-slots")


def pair_documents(pairs: DataFrame, found: DataFrame, doc: str = "doc_id", flag: str = "exp", spread: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(a, b, doc, flag): the documents that hold both terms of each distinct pair (a, b).

    Those of the rarer term are looked through for the other, so a common term
    costs no more than the rare one that it stands with; a term's documents
    stay dealt over many tasks.  ``spread`` is what ``_spread`` gave for
    ``found``, if it did already.
    """
    spread, of = spread or _spread(found, doc, flag)
    side = lambda c: of.select(F.col("term").alias(c), F.struct("_n", "term", "_slots").alias(f"_{c}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    rare, other = F.least("_a", "_b"), F.greatest("_a", "_b")
    both = both.select("a", "b", rare["term"].alias("term"), other["term"].alias("_other"), rare["_slots"].alias("_bits"))
    met = both.select("a", "b", "term", "_other", each_slot("_bits").alias("_slot")).join(spread, ["term", "_slot"])
    return met.select("a", "b", doc, flag, F.col("_other").alias("term")).join(found.select(doc, "term"), [doc, "term"], "left_semi").drop("term")


def counts(candidates: DataFrame, found: DataFrame, doc: str = "doc_id", flag: str = "exp") -> DataFrame:
    """Per candidate (cand, src, mid, dst): documents that hold each of ``SETS``, and for ``FLAGGED`` those with the flag.

    ``found`` is (doc, term, flag), each once.  A pair of terms is counted
    once, whatever number of candidates share it, and a triple is looked for
    among the documents of its first pair.
    """
    c = kept(candidates.select("cand", "src", "mid", "dst").distinct(), "counted")
    spread, out = _spread(found, doc, flag), c
    for name, (a, b) in ((k, v) for k, v in SETS.items() if len(v) == 2):
        met = pair_documents(c.select(F.col(a).alias("a"), F.col(b).alias("b")), found, doc, flag, spread).withColumnsRenamed({"a": a, "b": b})
        sums = [F.count(F.lit(1)).alias(name)] + ([F.count_if(flag).alias(f"{name}_exp")] if name in FLAGGED else [])
        if name == "pair_sm":
            met = kept(met, "met")
            three = c.select("src", "mid", F.col("dst").alias("term")).distinct().join(met, ["src", "mid"]).join(found.select(doc, "term"), [doc, "term"], "left_semi")
            three = kept(three.groupBy("src", "mid", F.col("term").alias("dst")).agg(F.count(F.lit(1)).alias("triple_smd"), F.count_if(flag).alias("triple_smd_exp")), "triples")
            out = out.join(three, ["src", "mid", "dst"], "left")
        out = out.join(kept(met.groupBy(a, b).agg(*sums), "pair-counts"), [a, b], "left")  # each a plan of its own: the driver holds whole plans
    return out.select("cand", *SETS, *[f"{k}_exp" for k in FLAGGED]).na.fill(0)


def chain_counts(chains: DataFrame, found: DataFrame, doc: str = "doc_id", flag: str = "exp") -> DataFrame:
    """(cand, full_chain, full_chain_exp): documents that hold all distinct terms of ``chains`` (cand, term).

    The documents of a chain's rarest term are looked through for the others,
    so a common term costs no more than the rarest that it stands with.
    """
    wanted = kept(chains.select("cand", "term").distinct(), "chains")
    spread, of = _spread(found, doc, flag)
    known = wanted.join(of, "term", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    first = known.groupBy("cand").agg(F.min(F.struct("_n", "term", "_slots")).alias("_first"), F.count(F.lit(1)).alias("_size"))
    first = first.filter("_first._n > 0").select("cand", "_size", F.col("_first.term").alias("term"), each_slot("_first._slots").alias("_slot"))
    first = kept(first, "rarest")
    rows = first.join(spread, ["term", "_slot"]).select("cand", "_size", doc, F.col(flag).alias("_flag"))
    met = rows.join(wanted, "cand").join(found.select(doc, "term").distinct(), [doc, "term"], "left_semi")
    met = met.groupBy("cand", doc, "_size").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_flag").alias("_flag")).filter("_n = _size")
    out = met.groupBy("cand").agg(F.count(F.lit(1)).alias("full_chain"), F.count_if("_flag").alias("full_chain_exp"))
    return wanted.select("cand").distinct().join(out, "cand", "left").na.fill(0)


def edge_counts(paths: DataFrame, found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(cand, pos, a, b, n): documents that hold both terms of each step of ``paths`` (cand, nodes)."""
    steps = paths.select("cand", F.posexplode(F.zip_with(F.slice("nodes", 1, F.size("nodes") - 1), F.slice("nodes", 2, F.size("nodes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pos", "s"))
    steps = kept(steps.select("cand", "pos", "s.a", "s.b"), "path-steps")
    both = pair_documents(steps, found.select("term", doc, F.lit(False).alias("_flag")).distinct(), doc, "_flag")
    n = kept(both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "step-counts")
    return steps.join(n, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0))).select("cand", "pos", "a", "b", "n")


def bottleneck(edges: DataFrame) -> DataFrame:
    """(cand, a, b, n): each candidate's step with the fewest documents, the first of equals."""
    return edges.groupBy("cand").agg(F.min_by(F.struct("a", "b", "n"), F.struct("n", "pos")).alias("m")).select("cand", "m.a", "m.b", "m.n")


def aggregated(hops: DataFrame, key: str = "cand", ceiling: int = 500) -> DataFrame:
    """Per candidate, of hop rows (key, hop, count, db_hits): counts by hop, chain count with a bonus of 10 per hit up to 50, novelty, bottleneck, recommendation."""
    of = lambda hop: F.coalesce(F.max(F.when(F.col("hop") == hop, F.col("count"))), F.lit(0))
    hits = F.aggregate(F.map_values("db_hits"), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(False)).cast("int"))
    out = hops.groupBy(key).agg(of("source_mid").alias("source_mid"), of("mid_target").alias("mid_target"), of("source_target").alias("source_target"), F.least(F.lit(50), 10 * F.coalesce(F.sum(hits), F.lit(0))).alias("db_bonus"))
    out = out.withColumn("chain_count_raw", F.least("source_mid", "mid_target")).withColumn("chain_count", F.col("chain_count_raw") + F.col("db_bonus"))
    novelty = F.lit(1.0) if ceiling <= 0 else novelty_by_ceiling(F.col("chain_count"), ceiling)
    first = F.col("source_mid") <= F.col("mid_target")
    out = out.withColumn("_novelty", novelty).withColumn("bottleneck", F.when(first, "source_mid").otherwise("mid_target"))
    level = F.when(F.col("_novelty") > 0.7, "high").when(F.col("_novelty") > 0.3, "moderate").otherwise("low")
    return out.withColumn("recommendation", level).withColumn("chain_novelty", F.round("_novelty", 4)).drop("_novelty")


def best_chains(candidates: DataFrame, paths: DataFrame) -> DataFrame:
    """Candidates (cand, ...) with has_path, path (the first by length, then text) and n_paths; without a path they stay."""
    from .graph import path_text

    best = paths.withColumn("_text", path_text()).groupBy("cand").agg(F.min(F.struct("length", "_text", "nodes")).alias("m"), F.count(F.lit(1)).alias("n_paths"))
    out = candidates.join(best, "cand", "left")
    return out.withColumns({"has_path": F.col("m").isNotNull(), "path": F.col("m._text"), "path_nodes": F.col("m.nodes"), "n_paths": F.coalesce("n_paths", F.lit(0))}).drop("m")


def matching(specs: DataFrame, found: DataFrame, most: int = 40, doc: str = "doc_id") -> DataFrame:
    """(spec, doc, score, nth): documents that meet every clause of ``specs`` (spec, clause, term) by any of its terms, at most ``most`` each.

    Those that hold more of the terms come first, then the lesser id.  Only the
    documents of a spec's rarest clause are looked through for the others.
    """
    wanted = kept(specs.select("spec", "clause", "term").distinct(), "specs")
    spread, of = _spread(found.select(doc, "term").distinct(), doc)
    known = kept(wanted.join(of, "term", "left").withColumn("_n", F.coalesce("_n", F.lit(0))), "spec-terms")
    clauses = known.groupBy("spec", "clause").agg(F.sum("_n").alias("_n"))
    rarest = clauses.groupBy("spec").agg(F.min(F.struct("_n", "clause")).alias("_first"), F.count(F.lit(1)).alias("_size")).select("spec", "_size", "_first.clause")
    first = known.filter("_n > 0").join(rarest, ["spec", "clause"]).select("spec", "_size", "term", each_slot("_slots").alias("_slot"))
    rows = first.join(spread, ["term", "_slot"]).select("spec", "_size", doc).distinct()
    met = rows.join(wanted, "spec").join(found.select(doc, "term").distinct(), [doc, "term"], "left_semi")
    met = met.groupBy("spec", doc, "_size").agg(F.count_distinct("clause").alias("_n"), F.count_distinct("term").alias("score")).filter("_n = _size")
    nth = F.row_number().over(Window.partitionBy("spec").orderBy(F.desc("score"), doc))
    return met.select("spec", doc, "score", nth.alias("nth")).filter(F.col("nth") <= most)


def spec_log(specs: DataFrame, found: DataFrame) -> DataFrame:
    """(spec, n): documents returned per spec, 0 included."""
    n = found.groupBy("spec").agg(F.count(F.lit(1)).alias("n"))
    return specs.select("spec").distinct().join(n, "spec", "left").na.fill(0)


def merged_articles(articles: DataFrame, order: Sequence[str] = ("list", "at")) -> DataFrame:
    """One row per article: of those with the same id, or without an id the same title, whatever the case, the first by list and place."""
    key = F.lower(F.trim(F.when(F.coalesce("pmid", F.lit("")) != "", F.concat(F.lit("id:"), "pmid")).otherwise(F.concat(F.lit("title:"), F.coalesce("title", F.lit(""))))))
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return articles.withColumn("_key", key).withColumn("_nth", nth).filter("_nth = 1").drop("_key", "_nth")


def query_specs(candidates: DataFrame, target: str, most: int = 100, first: int = 60) -> DataFrame:
    """(family, query, at): search texts from the candidates (cand_rank, src, mid): pair, source and target, mid and target, all three; each text once."""
    from ..functions.names import all_of

    c = candidates.filter(F.col("cand_rank") <= first)
    families = [("pair", ["src", "mid"]), ("source_target", ["src", "dst"]), ("mid_target", ["mid", "dst"]), ("triple", ["src", "mid", "dst"])]
    c = c.withColumn("dst", F.lit(target))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("family"), all_of(F.array(*cols)).alias("query")) for i, (f, cols) in enumerate(families)]))
    rows = c.select("cand_rank", each.alias("s")).select("cand_rank", "s.*")
    once = rows.groupBy(F.lower("query").alias("_key")).agg(F.min(F.struct("i", "cand_rank", "family", "query")).alias("m")).select("m.*")
    return once.orderBy("i", "cand_rank").limit(most).select("family", "query", "cand_rank")


def new_keys(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """What isn't in the stored results yet; failures aren't stored, so they come again."""
    return wanted.select(key).distinct().join(stored.select(key).distinct(), key, "left_anti")
