"""The whole ranking, from coordinates to quadrants; each stage takes the table of the one before it.

    tables = ranking.run(coordinates, nodes, edges, docs, "colitis", ["mice", "in vitro"], out="/shared/run-1")
    tables["quadrants"].show()

Stages: candidates, chains (paths in the graph), incidence (their terms in the
corpus), novelty (co-occurrence), evidence (hops and reference tables) and
quadrants.  Every stage is a Parquet table below the folder ``out``, written
once and read by the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.names import search_term
from .operators import corpus, graph, quadrant, refmatch, signal
from .sources.shared import kept

#: The terms of each hop, and the count that stands for it.
HOPS = {"source_mid": ("src", "mid", "pair_sm"), "mid_target": ("mid", "dst", "pair_md"), "source_target": ("src", "dst", "pair_sd")}


@dataclass
class Reference:
    """A table of known pairs: a hit for candidates of which both names of the hop match those of a row."""

    hop: str
    table: DataFrame
    name_a: str
    name_b: str


def candidates(coordinates: DataFrame, target: str, n: int = 200) -> DataFrame:
    """(cand, src, mid, dst, signal, ...): the ``n`` best pairs of (src, mid, value) rows; cand is the pair as one text."""
    return signal.candidates(coordinates, n).withColumns({"dst": F.lit(target), "cand": F.to_json(F.array("src", "mid"))})


def chains(found: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 3, between: DataFrame | None = None) -> DataFrame:
    """Candidates with has_path, path, path_nodes, n_paths and terms (the path's search terms); those without a path stay."""
    ids = kept(graph.resolve(found.select(F.explode(F.array("src", "mid")).alias("name")), nodes).select("name", "id"), "ids")
    ends = found.select("cand", "src", "mid").join(ids.select(F.col("name").alias("src"), F.col("id").alias("start")), "src").join(ids.select(F.col("name").alias("mid"), F.col("id").alias("end")), "mid")
    ends = kept(ends, "ends")
    paths = graph.simple_paths(edges, ends.select("start", "end"), depth, between=between).join(ends.select("cand", "start", "end"), ["start", "end"])
    out = corpus.best_chains(found, paths)
    return out.withColumn("terms", F.transform(F.coalesce("path_nodes", F.array().cast("array<string>")), lambda x: search_term(x, F.col("src"), F.col("mid"))))


def _plain(c):
    return F.replace(c, F.lit("_"), F.lit(" "))


def _steps(chained: DataFrame) -> DataFrame:
    return chained.filter(F.size("terms") > 1).select("cand", F.transform("terms", _plain).alias("nodes"))


def incidence(chained: DataFrame, docs: DataFrame, experimental: Sequence[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, term, exp): the candidates' and their paths' terms in the corpus, and whether the document is an experimental one."""
    terms = chained.select(F.explode(F.array(*[_plain(F.col(c)) for c in ("src", "mid", "dst")])).alias("term")).unionByName(_steps(chained).select(F.explode("nodes").alias("term"))).distinct()
    flagged = docs.select(doc, text, corpus.experimental(F.col(text), experimental).alias("exp"))
    return corpus.incidence(flagged, terms, doc, text, flags=["exp"])


def novelty(chained: DataFrame, held: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``chained`` with document counts, chain_count, novelty, and the step of the path with the fewest documents.

    chain_count: the experimental documents that hold all three terms.
    Novelty is relative to the largest such count.  ``held`` is what
    ``incidence`` gives; it is read three times, so it should be a table.
    """
    asked = chained.select("cand", *[_plain(F.col(c)).alias(c) for c in ("src", "mid", "dst")])
    long = chained.filter(F.size("terms") > 2).select("cand", F.explode(F.concat("terms", F.array("dst"))).alias("term")).withColumn("term", _plain(F.col("term")))
    counted = [kept(t, "counts") for t in (corpus.counts(asked, held, doc), corpus.chain_counts(long, held, doc))]
    weakest = kept(corpus.bottleneck(corpus.edge_counts(_steps(chained), held, doc)).select("cand", F.struct("a", "b", "n").alias("bottleneck")), "weakest")
    out = chained.join(counted[0], "cand").join(counted[1], "cand", "left").join(weakest, "cand", "left").withColumn("chain_count", F.col("triple_smd_exp"))
    most = out.agg(F.max("chain_count").alias("_most"))  # one row
    return out.crossJoin(F.broadcast(most)).withColumn("novelty", quadrant.novelty_by_batch(F.col("chain_count"), F.col("_most"))).drop("_most")


def evidence(scored: DataFrame, references: Mapping[str, Reference] | None = None, ceiling: int = 500) -> DataFrame:
    """(cand, source_mid, mid_target, source_target, db_bonus, chain_count, chain_novelty, bottleneck, recommendation) from hop counts and reference tables."""
    named = scored.filter("trim(src) != '' AND trim(mid) != ''")
    one = [F.struct(F.lit(hop).alias("hop"), F.col(a).alias("a"), F.col(b).alias("b"), F.col(n).alias("count")) for hop, (a, b, n) in HOPS.items()]
    hops = kept(named.select("cand", F.explode(F.array(*one)).alias("h")).select("cand", "h.*"), "hops")
    hits = None
    for name, ref in (references or {}).items():
        pairs = hops.filter(F.col("hop") == ref.hop).select("a", "b").distinct()
        table = ref.table.select(F.monotonically_increasing_id().alias("row"), F.col(ref.name_a).alias("_a"), F.col(ref.name_b).alias("_b"))
        met = kept(refmatch.pair_matches(pairs, kept(table, "reference"), "a", "b", "_a", "_b").select(F.lit(ref.hop).alias("hop"), "a", "b", F.lit(name).alias("db")).distinct(), "met")
        hits = met if hits is None else hits.unionByName(met)
    none = F.create_map().cast("map<string,boolean>")
    if hits is None:
        return corpus.aggregated(hops.select("cand", "hop", "count", none.alias("db_hits")), ceiling=ceiling)
    by = hits.groupBy("hop", "a", "b").agg(F.map_from_entries(F.collect_list(F.struct("db", F.lit(True)))).alias("db_hits"))  # one entry per reference at most
    return corpus.aggregated(hops.join(by, ["hop", "a", "b"], "left").withColumn("db_hits", F.coalesce("db_hits", none)), ceiling=ceiling)


def run(
    coordinates: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    docs: DataFrame,
    target: str,
    experimental: Sequence[str],
    out: str,
    references: Mapping[str, Reference] | None = None,
    n: int = 200,
    depth: int = 3,
    between: DataFrame | None = None,
    doc: str = "doc_id",
    text: str = "text",
) -> dict[str, DataFrame]:
    """The stages' tables by name."""

    def stage(name: str, df: DataFrame) -> DataFrame:
        path = f"{out.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    tables = {"candidates": stage("candidates", candidates(coordinates, target, n))}
    tables["chains"] = stage("chains", chains(tables["candidates"], nodes, edges, depth, between))
    tables["incidence"] = stage("incidence", incidence(tables["chains"], docs, experimental, doc, text))
    tables["novelty"] = stage("novelty", novelty(tables["chains"], tables["incidence"], doc))
    tables["evidence"] = stage("evidence", evidence(tables["novelty"], references))
    tables["quadrants"] = stage("quadrants", quadrant.assigned(tables["novelty"]))
    return tables
