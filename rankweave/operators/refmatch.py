"""Matching of names against reference tables by containment, without comparing every name with every other.

If a name of three letters or more lies in another, all its three-letter grams
do.  Each name sends its rarest gram, each possible container all its grams; an
equi-join on the gram makes candidates, and containment is then checked.  Names
of one or two letters, of which there are few, go by their whole text against
the grams of that length, in the same join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

GRAM = 3


def _grams(name: Column, n: int) -> Column:
    return F.when(F.length(name) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - n + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contained(inner: DataFrame, outer: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): every name of ``inner`` (distinct a) with each of ``outer`` (distinct b) that holds it; blank names are in none."""
    x, y = kept(inner.select(a).filter(F.col(a) != ""), "inner"), kept(outer.select(b).filter(F.col(b) != ""), "outer")
    return _contained(x, y, a, b)


def _contained(x: DataFrame, y: DataFrame, a: str, b: str) -> DataFrame:
    """``contained`` of tables without blank names, which are read twice."""
    grams = y.select(b, F.explode(F.concat(*[_grams(F.col(b), n) for n in range(1, GRAM + 1)])).alias("g"))
    common = grams.filter(F.length("g") == GRAM).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    sent = F.when(F.length(a) >= GRAM, _grams(F.col(a), GRAM)).otherwise(F.array(a))
    own = x.select(a, F.explode(sent).alias("g")).join(common, "g", "left")
    rarest = own.groupBy(a).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).select(a, "m.g")
    return rarest.join(grams, "g").filter(F.contains(F.col(b), F.col(a))).select(a, b)


def either_way(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): distinct names of which one holds the other."""
    x, y = kept(left.select(a).filter(F.col(a) != ""), "left"), kept(right.select(b).filter(F.col(b) != ""), "right")
    one, two = kept(_contained(x, y, a, b), "held"), kept(_contained(y, x, b, a).select(a, b), "held", after=[x, y])
    return kept(one.unionByName(two).distinct(), "either-way", after=[one, two])


def normalised(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the columns trimmed and in lower case, null as empty."""
    return df.withColumns({c: F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in columns})


def matches(queries: DataFrame, table: DataFrame, query: str, name: str) -> DataFrame:
    """Rows of ``table`` for each distinct query whose name matches either way, both in normal form."""
    from ..functions.names import spaced

    q = queries.select(query).distinct().withColumn("_q", spaced(F.col(query)))
    t = table.withColumn("_t", spaced(F.col(name)))
    pairs = either_way(q.select("_q").distinct(), t.select("_t").distinct(), "_q", "_t")
    return q.join(pairs, "_q").join(t, "_t").drop("_q", "_t")


def with_synonyms(queries: DataFrame, query: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(query, form): each query itself and the names that its short form stands for."""
    each = [F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, vs in groups.items() for v in vs]
    q = queries.select(query).distinct()
    out = q.select(query, F.col(query).alias("form"))
    if each:
        more = q.withColumn("_s", F.explode(F.array(*each))).filter(F.lower(F.trim(query)) == F.col("_s.k")).select(query, F.col("_s.v").alias("form"))
        out = out.unionByName(more)
    return out.distinct()


def pair_matches(pairs: DataFrame, table: DataFrame, a: str, b: str, name_a: str, name_b: str, groups: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Rows of ``table`` (with a unique column row) for each pair (a, b) of which both names match; ``groups`` gives synonyms of b."""
    p = pairs.select(a, b).distinct()
    one = kept(matches(p, table.select("row", name_a), a, name_a).select(a, "row").distinct(), "rows-of-a")
    forms = with_synonyms(p, b, groups or {})
    two = matches(forms.select("form"), table.select("row", name_b), "form", name_b).join(forms, "form").select(b, "row").distinct()
    two = kept(two, "rows-of-b")
    return p.join(one, a).join(two, [b, "row"]).join(table, "row")


def with_fallback(queries: DataFrame, neighbours: DataFrame, table: DataFrame, query: str, name: str) -> DataFrame:
    """Direct matches; for queries without any those of the first neighbour (query, rank, neighbour) that has some.  Adds method: direct or the neighbour's name."""
    direct = matches(queries, table, query, name).withColumn("method", F.lit("direct"))
    rest = queries.select(query).distinct().join(direct.select(query).distinct(), query, "left_anti")
    asked = neighbours.join(rest, query)
    found = matches(asked.select("neighbour"), table, "neighbour", name)
    rows = asked.join(found, "neighbour")
    first = rows.groupBy(query).agg(F.min("rank").alias("rank"))
    rows = rows.join(first, [query, "rank"]).withColumn("method", F.col("neighbour"))
    return direct.unionByName(rows.select(direct.columns))


def _with_neighbours(pairs: DataFrame, neighbours: DataFrame, name: str, itself: bool = True) -> DataFrame:
    """(name, rank, form): each name itself at rank 0 and its neighbours (query, rank, neighbour) at theirs; of repeated forms the first."""
    own = pairs.select(name).distinct()
    near = neighbours.select(F.col("query").alias(name), "rank", F.col("neighbour").alias("form")).join(own, name, "left_semi")
    if itself:
        near = near.unionByName(own.select(name, F.lit(0).alias("rank"), F.col(name).alias("form")))
    return near.groupBy(name, "form").agg(F.min("rank").cast("int").alias("rank"))


def pairs_with_fallback(pairs: DataFrame, near_a: DataFrame, near_b: DataFrame, table: DataFrame, a: str, b: str, name_a: str, name_b: str, groups: Mapping[str, Sequence[str]] | None = None, first: bool = True) -> DataFrame:
    """``pair_matches``, and for pairs without any the rows that their names' neighbours match.

    near_a, near_b: query, rank (from 1), neighbour.  Adds rank_a and rank_b (0
    is the name itself) and method (direct or neighbour).  With ``first`` the
    combinations are tried in order, all of b's forms for each of a's, names
    themselves first; the first with rows wins.  Else all rows count that any
    neighbour of a and any of b match, each row once with its first
    combination.  A combination is never made before both of its forms match a
    row: forms are matched to rows once each, and meet there.  Null and blank
    names match nothing.
    """
    pairs = kept(pairs.select(a, b).distinct(), "pairs")
    direct = kept(pair_matches(pairs, table, a, b, name_a, name_b, groups), "direct")
    rest = kept(pairs.join(direct.select(a, b).distinct(), [a, b], "left_anti"), "rest")
    forms_a, forms_b = kept(_with_neighbours(rest, near_a, a, first), "forms"), kept(_with_neighbours(rest, near_b, b, first), "forms")
    one = matches(forms_a.select("form"), table.select("row", name_a), "form", name_a).join(forms_a, "form")
    one = kept(one.groupBy(a, "row").agg(F.min("rank").alias("rank_a")), "rows")
    more = with_synonyms(forms_b.select(F.col("form").alias("of")), "of", groups or {})
    two = matches(more.select("form"), table.select("row", name_b), "form", name_b).join(more, "form").join(forms_b.withColumnRenamed("form", "of"), "of")
    two = kept(two.groupBy(b, "row").agg(F.min("rank").alias("rank_b")), "rows")
    # for one row the least ranks of both sides are its first combination
    met = rest.join(one, a).join(two, [b, "row"])
    if first:
        best = met.groupBy(a, b).agg(F.min(F.struct("rank_a", "rank_b")).alias("best"))
        met = met.join(best, [a, b]).filter((F.col("rank_a") == F.col("best.rank_a")) & (F.col("rank_b") == F.col("best.rank_b"))).drop("best")
    met = met.join(table, "row").withColumn("method", F.lit("neighbour"))
    zero = F.lit(0)
    return direct.withColumns({"rank_a": zero, "rank_b": zero, "method": F.lit("direct")}).unionByName(met)


def _first(found: DataFrame, keys: list[str], order: str, value: str, most: int, out: str) -> DataFrame:
    """(keys, out): the values of each group's first ``most`` rows, which alone are gathered."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    some = found.withColumn("_nth", nth).filter(F.col("_nth") <= most)
    return some.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nth", value))), lambda x: x[value]).alias(out))


def evidence(found: DataFrame, keys: Sequence[str], kind: str = "edge_type", detail: str = "detail", row: str = "row", most: int = 5) -> DataFrame:
    """Per query: hit, records, distinct kinds in order, and the first ``most`` details by row."""
    keys = list(keys)
    out = found.groupBy(*keys).agg((F.count(F.lit(1)) > 0).alias("hit"), F.count(F.lit(1)).alias("records"))
    kinds = found.filter(F.coalesce(kind, F.lit("")) != "").select(*keys, kind).distinct()
    kinds = kinds.groupBy(*keys).agg(F.array_sort(F.collect_list(kind)).alias("edge_types"))
    return out.join(kinds, keys, "left").join(_first(found, keys, row, detail, most, "details"), keys, "left")


def names_of(found: DataFrame, key: str, name: str, source: str, most: int = 50) -> DataFrame:
    """Per query: the first ``most`` distinct names in order, the distinct sources, and the number of rows."""
    names = found.filter(F.coalesce(name, F.lit("")).isin("", "NA") == F.lit(False)).select(key, name).distinct()
    sources = found.select(key, source).distinct().groupBy(key).agg(F.array_sort(F.collect_list(source)).alias("sources"))
    out = found.groupBy(key).agg(F.count(F.lit(1)).alias("records")).join(sources, key, "left")
    return out.join(_first(names, [key], name, name, most, "names"), key, "left")
