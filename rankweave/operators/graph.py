"""Property-graph operators over nodes (id, label, type, ...) and edges (source, target, relation, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

from ..functions import names, texts


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by type and edges by relation; name is null for the totals."""
    by = lambda df, kind, c: df.cube(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return by(nodes, "node", "type").unionByName(by(edges, "edge", "relation"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, out_degree) of every node that has an edge; parallel edges count."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("out")), F.struct(F.col("target").alias("id"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("e.id").agg(F.count(F.lit(1)).alias("degree"), F.sum("e.out").alias("out_degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions: (source, target, relation, forward)."""
    out = edges.select("source", "target", "relation", F.lit(True).alias("forward"))
    return out.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", F.lit(False).alias("forward")))


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """(id, neighbour, relation, forward) of every node."""
    rows = both_ways(edges)
    if direction != "both":
        rows = rows.filter("forward" if direction == "out" else "NOT forward")
    return rows.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), "relation", "forward")


def khop(edges: DataFrame, seeds: DataFrame, k: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, id, hop): nodes within ``k`` hops of the seeds (keys, id) in either direction, with the least number of hops."""
    keys = list(keys)
    step = both_ways(edges).select(F.col("source").alias("id"), F.col("target").alias("_to")).distinct()
    found = seeds.select(*keys, "id").distinct().withColumn("hop", F.lit(0))
    frontier = found
    for hop in range(1, k + 1):
        reached = frontier.select(*keys, "id").join(step, "id").select(*keys, F.col("_to").alias("id")).distinct()
        frontier = reached.join(found, [*keys, "id"], "left_anti").withColumn("hop", F.lit(hop))
        found = found.unionByName(frontier)
    return found


def induced(edges: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The edges whose ends are both among the nodes (keys, id)."""
    keys = list(keys)
    if not keys:
        ids = nodes.select("id").distinct()
        return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    a = nodes.select(*keys, F.col("id").alias("source")).distinct()
    return edges.join(a, "source").join(nodes.select(*keys, F.col("id").alias("target")).distinct(), [*keys, "target"])


def simple_paths(edges: DataFrame, pairs: DataFrame, depth: int = 3, directed: bool = True, between: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """(start, end, nodes, relations, length): paths without repeated nodes from start to end of ``pairs``, of at most ``depth`` edges.

    ``between``: the ids allowed inside a path.  ``k``: a pair that has so many
    paths gets none that are longer; of the last length all stay, so that the
    ``k`` shortest can be chosen.  Halves grow from the starts and from the
    ends, once for each node however many pairs it is in, and meet in the
    middle by end and node together, so a hub's halves lie in many tasks.
    """
    step = (edges.select("source", "target", "relation") if directed else both_ways(edges).select("source", "target", "relation")).distinct()
    step = kept(step, "steps")
    allowed = lambda c: step if between is None else step.join(between.select(F.col("id").alias(c)).distinct(), c, "left_semi")
    todo = kept(pairs.select("start", "end").filter("start != end").distinct(), "pairs")
    out = ["start", "end", "nodes", "relations", "length"]
    none = F.array().cast("array<string>")
    one = todo.join(step, (F.col("start") == F.col("source")) & (F.col("end") == F.col("target")))
    done = [kept(one.select("start", "end", F.array("start", "end").alias("nodes"), F.array("relation").alias("relations"), F.lit(1).alias("length")), "paths")]
    # halves by their number of edges: from the start to a node, and from a node to the end
    ahead = [todo.select("start", F.col("start").alias("node"), F.array("start").alias("nodes"), none.alias("relations")).distinct()]
    back = [todo.select("end", F.col("end").alias("node"), F.array("end").alias("nodes"), none.alias("relations")).distinct()]
    for length in range(2, depth + 1):
        if k is not None:
            enough = reduce(DataFrame.unionByName, done).groupBy("start", "end").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
            todo = kept(todo.join(enough, ["start", "end"], "left_anti"), "pairs")
            if todo.isEmpty():
                break
        first, second = (length + 1) // 2, length // 2
        if len(ahead) <= first:
            rows = ahead[-1].join(todo.select("start").distinct(), "start", "left_semi").join(allowed("target").withColumnRenamed("source", "node"), "node").filter(~F.array_contains("nodes", F.col("target")))
            ahead.append(kept(rows.select("start", F.col("target").alias("node"), F.array_append("nodes", F.col("target")).alias("nodes"), F.array_append("relations", F.col("relation")).alias("relations")), "ahead"))
        if len(back) <= second:
            rows = back[-1].join(todo.select("end").distinct(), "end", "left_semi").join(allowed("source").withColumnRenamed("target", "node"), "node").filter(~F.array_contains("nodes", F.col("source")))
            back.append(kept(rows.select("end", F.col("source").alias("node"), F.array_prepend("nodes", F.col("source")).alias("nodes"), F.array_prepend("relations", F.col("relation")).alias("relations")), "back"))
        met = todo.join(ahead[first], "start").join(back[second].withColumnsRenamed({"nodes": "_nodes", "relations": "_relations"}), ["end", "node"])
        rest = F.slice("_nodes", 2, depth)
        met = met.filter(~F.arrays_overlap("nodes", rest)).select("start", "end", F.concat("nodes", rest).alias("nodes"), F.concat("relations", "_relations").alias("relations"), F.lit(length).alias("length"))
        done.append(kept(met.select(out), "paths"))
    return reduce(DataFrame.unionByName, done)


def path_text(nodes: str = "nodes", relations: str = "relations") -> Column:
    """a -[relation]-> b ..."""
    rest = F.zip_with(F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))), F.col(relations), lambda n, r: F.concat(F.lit(" -["), r, F.lit("]-> "), n))
    return F.concat(F.element_at(nodes, 1), F.array_join(rest, ""))


def shortest(paths: DataFrame, k: int = 5, keys: Sequence[str] = ("start", "end")) -> DataFrame:
    """The ``k`` shortest paths of each pair, in order of length, then text."""
    by = Window.partitionBy(*keys).orderBy("length", path_text())
    return paths.withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= k)


def resolve(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id, how) for the names that are found: by id, else by a label that holds the name or lies in it, else by <type>_<name>; of several ids the least.

    A node without a label has its id as label; an empty label matches nothing.
    """
    n = kept(nodes.select("id", F.coalesce(F.nullif("label", F.lit("")), "id").alias("label"), "type"), "nodes")
    w = kept(wanted.select("name").distinct(), "wanted")
    by_id = w.join(n.select(F.col("id").alias("name"), "id"), "name").select("name", "id", F.lit(1).alias("how"))
    from .refmatch import either_way

    labels = n.select(names.spaced(F.col("label")).alias("label"), F.col("id")).distinct()
    asked = w.select("name", names.spaced(F.col("name")).alias("plain"))
    pairs = either_way(asked.select("plain").distinct(), labels.select("label").distinct(), "plain", "label")
    by_label = asked.join(pairs, "plain").join(labels, "label").select("name", "id", F.lit(2).alias("how"))
    pattern = asked.join(n.select("id", "type"), F.col("id") == F.concat_ws("_", "type", names.dotless(F.col("name")))).select("name", "id", F.lit(3).alias("how"))
    found = by_id.unionByName(by_label).unionByName(pattern)
    return found.groupBy("name").agg(F.min(F.struct("how", "id")).alias("m")).select("name", "m.id", "m.how")


def resolve_exact(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, type, id): by id or label in normal form, else by the acid or salt of the same name; only nodes of the wanted type."""
    forms = nodes.select("id", "type", F.explode(F.array_distinct(F.array(names.underscored(F.col("id")), names.underscored(F.coalesce("label", F.lit("")))))).alias("form")).filter("form != ''")
    w = wanted.select("name", "type").distinct().withColumn("plain", names.underscored(F.col("name")))
    tries = w.select("name", "type", F.posexplode(F.concat(F.array("plain"), names.salt_variants(F.col("plain")))).alias("how", "form"))
    return tries.join(forms, ["type", "form"]).groupBy("name", "type").agg(F.min(F.struct("how", "id")).alias("m")).select("name", "type", "m.id")


def best_substring(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, id): the node whose id or label is the name, else the one whose label holds it with the least to spare."""
    from .refmatch import contained

    labels = nodes.select("id", names.spaced(F.coalesce("label", "id")).alias("label")).distinct()
    w = wanted.select("name", names.spaced(F.col("name")).alias("plain")).distinct()
    pairs = contained(w.select("plain").distinct(), labels.select("label").distinct(), "plain", "label")
    rows = w.join(pairs, "plain").join(labels, "label")
    rows = rows.withColumn("score", F.when(F.col("plain") == F.col("label"), 2.0).otherwise(F.length("plain") / F.length("label")))
    return rows.groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("m")).select("name", "m.id")


def built(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extraction rows: kind ('node' or 'edge'), at (order), id, type, description / source, target, relation, pmid.

    The first row of a node sets its type, the first non-empty description
    stays; the first row of an edge sets its relation, its ids are gathered in
    order without repeats.  Ends that no row describes become nodes of type
    unknown.
    """
    n = extracted.filter("kind = 'node'").groupBy("id").agg(F.min_by("type", "at").alias("type"), F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col("at"))).alias("description"))
    e = extracted.filter("kind = 'edge'")
    firsts = e.groupBy("source", "target").agg(F.min_by("relation", "at").alias("relation"))
    ids = e.filter("pmid IS NOT NULL AND pmid != ''").groupBy("source", "target", "pmid").agg(F.min("at").alias("at"))
    ids = ids.groupBy("source", "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "pmid"))), lambda x: x["pmid"]).alias("pmids"))
    edges = firsts.join(ids, ["source", "target"], "left").withColumn("pmids", F.coalesce("pmids", F.array().cast("array<string>")))
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct().join(n, "id", "left_anti")
    return n.unionByName(ends.select("id", F.lit("unknown").alias("type"), F.lit(None).cast("string").alias("description"))), edges


def collapsed(edges: DataFrame, alias: DataFrame, order: str = "at") -> DataFrame:
    """Edges with ends renamed by ``alias`` (id, canonical): of edges that fall together the last one's attributes stay; loops go."""
    a = alias.select(F.col("id").alias("_id"), F.col("canonical").alias("_to"))
    for end in ("source", "target"):
        edges = edges.join(a, F.col(end) == F.col("_id"), "left").withColumn(end, F.coalesce("_to", F.col(end))).drop("_id", "_to")
    rest = [c for c in edges.columns if c not in ("source", "target", order)]
    return edges.filter("source != target").groupBy("source", "target").agg(*[F.max_by(c, order).alias(c) for c in rest])


def without_intermediates(nodes: DataFrame, kind: str) -> DataFrame:
    """(id) of nodes of other types: what may lie inside a path."""
    return nodes.filter(F.col("type") != kind).select("id")


def type_view(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(id): nodes of a type and their direct neighbours, no farther."""
    own = nodes.filter(F.col("type") == kind).select("id")
    return khop(edges, own, 1).select("id")


def top_neighbours(edges: DataFrame, cores: DataFrame, k: int = 6, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, core, id): of each core node (keys, id) the ``k`` neighbours of largest degree."""
    keys = list(keys)
    next_to = neighbours(edges).select(F.col("id").alias("core"), F.col("neighbour").alias("id")).distinct()
    rows = cores.select(*keys, F.col("id").alias("core")).distinct().join(next_to, "core").join(degrees(edges).select("id", "degree"), "id")
    nth = F.row_number().over(Window.partitionBy(*keys, "core").orderBy(F.desc("degree"), "id"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= k).select(*keys, "core", "id")


def chain_subgraph(edges: DataFrame, triples: DataFrame, k: int = 6, focused: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per (triple, src, mid, dst) of resolved ids: nodes (triple, id, is_core) and edges (.., is_chain) around the three.

    is_chain: both ends are core nodes.  ``focused`` leaves the neighbours out.
    """
    cores = triples.select("triple", F.explode(F.array("src", "mid", "dst")).alias("id")).distinct()
    found = cores.withColumn("is_core", F.lit(True))
    if not focused:
        more = top_neighbours(edges, cores, k, ["triple"]).select("triple", "id").distinct().join(cores, ["triple", "id"], "left_anti")
        found = found.unionByName(more.withColumn("is_core", F.lit(False)))
    own = induced(edges, found, ["triple"])
    mark = cores.select("triple", F.col("id"), F.lit(True).alias("_core"))
    own = own.join(mark.withColumnRenamed("id", "source"), ["triple", "source"], "left").withColumnRenamed("_core", "_a").join(mark.withColumnRenamed("id", "target"), ["triple", "target"], "left")
    return found, own.withColumn("is_chain", F.coalesce(F.col("_a") & F.col("_core"), F.lit(False))).drop("_a", "_core")


def downgraded(edges: DataFrame, nodes: DataFrame, source_type: str, target_type: str, relation: str, observational: Sequence[str], to: str = "associated_with") -> DataFrame:
    """Edges with ``relation`` between the two types weakened to ``to`` where the description speaks of observation only."""
    kind = lambda end: nodes.select(F.col("id").alias(end), F.col("type").alias(f"_{end}"))
    rows = edges.join(kind("source"), "source", "left").join(kind("target"), "target", "left")
    weak = (F.col("_source") == source_type) & (F.col("_target") == target_type) & (F.col("relation") == relation) & texts.any_of(F.coalesce("description", F.lit("")), observational)
    return rows.withColumn("relation", F.when(weak, to).otherwise(F.col("relation"))).drop("_source", "_target")


def node_evidence(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, source, target, labels, relation, ...): all edges at each wanted node, the most documented and cited first by ``nth``."""
    at = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), *edges.columns).join(ids.select("id").distinct(), "id", "left_semi")
    label = lambda end: nodes.select(F.col("id").alias(end), F.coalesce("label", "id").alias(f"{end}_label"))
    rows = at.join(label("source"), "source", "left").join(label("target"), "target", "left")
    by = Window.partitionBy("id").orderBy(F.desc("n_ids"), F.desc("cites"), "source", "target")
    return rows.withColumn("nth", F.row_number().over(by))


def hop_types(kind: str = "type", role: str = "role") -> Column:
    """The hops that concern a node, by its type and its role in the chain."""
    k, r = F.col(kind), F.col(role)
    one = lambda name: F.array(F.lit(name))
    none = F.array().cast("array<string>")
    src, mid, dst = (k == "source") | (r == "source"), (k == "mid") | (r == "mid"), (k == "target") | (r == "target")
    return F.array_distinct(F.concat(F.when(src | mid, one("source_mid")).otherwise(none), F.when(mid | dst, one("mid_target")).otherwise(none), F.when(src | dst, one("source_target")).otherwise(none)))


def enriched(edges: DataFrame, works: DataFrame) -> DataFrame:
    """Edges with impact, cites and year of their first id's work; other ids don't count."""
    first = edges.withColumn("_first", F.try_element_at("pmids", F.lit(1)))
    w = works.select(F.col("pmid").alias("_pmid"), "impact", "cites", "year")
    return first.join(w, F.col("_first") == F.col("_pmid"), "left").drop("_first", "_pmid")


def pair_facts(edges: DataFrame, pairs: DataFrame, nodes: DataFrame, kind: str, depth: int = 3) -> DataFrame:
    """(start, end, direct, paths, onward): direct relations either way, the first three paths, and the end's neighbours of a type."""
    way = both_ways(edges).select(F.col("source").alias("start"), F.col("target").alias("end"), F.concat("relation", F.when(F.col("forward"), F.lit("")).otherwise(F.lit(" (reverse)"))).alias("r"))
    direct = pairs.join(way, ["start", "end"]).groupBy("start", "end").agg(F.array_sort(F.collect_set("r")).alias("direct"))
    some = shortest(simple_paths(edges, pairs, depth), 3).withColumn("p", F.struct("nth", path_text().alias("t")))
    paths = some.groupBy("start", "end").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]).alias("paths"))
    out = edges.select(F.col("source").alias("end"), F.col("target").alias("id")).join(nodes.filter(F.col("type") == kind).select("id"), "id", "left_semi")
    onward = pairs.select("end").distinct().join(out, "end").groupBy("end").agg(F.array_sort(F.collect_set("id")).alias("onward"))
    return pairs.select("start", "end").distinct().join(direct, ["start", "end"], "left").join(paths, ["start", "end"], "left").join(onward, "end", "left")


def node_order(relations: Column) -> Column:
    """Node ids of (src, rel, dst) steps in the order they are first met."""
    return F.array_distinct(F.flatten(F.transform(relations, lambda x: F.array(x["src"], x["dst"]))))
