"""Ranks, medians and joins whose large groups no single task holds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Values among which one task looks for a wanted place.
FEW = 50_000
#: Slots over which the rows of a large group are dealt.
SLOTS = 64


def slot_of(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SLOTS)).cast("int")


def occupied(slot: str = "_slot") -> Column:
    """Aggregate: the slots that a group's rows lie in, as bits of a long."""
    return F.bit_or(F.expr(f"shiftleft(1L, {slot})"))


def each_slot(bits: str) -> Column:
    """A row per slot; on key and slot it meets the group's rows, which stay dealt out."""
    return F.explode(F.expr(f"filter(sequence(0, {SLOTS - 1}), s -> (shiftrightunsigned({bits}, s) & 1L) = 1L)"))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row among those with its keys, from 1.

    The rows are sorted by range, so a large group spans many tasks: a row's
    place in its task's run, plus the group's rows in the tasks before.
    ``order`` must leave no ties.  Null keys are a group of their own.
    """
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    at = kept(rows.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    runs = at.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task that a group spans
    runs = runs.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return joined(at, runs, [*keys, "_part"]).withColumn(name, (F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_part", "_shift")


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join on columns of the same names, in which nulls are equal."""
    right = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])
    return left.join(right, same).drop(*[f"_r{i}" for i in range(len(keys))])


def cumulative(counts: DataFrame, keys: Sequence[str], by: str, n: str = "n") -> DataFrame:
    """``counts`` with _before: the sum of ``n`` over the group's rows with a smaller ``by``; one row per keys and ``by``.

    The rows are sorted by range; a task adds up its own part of a group, and
    what the group has in the tasks before is carried over.
    """
    rows = counts.repartitionByRange(*keys, by).sortWithinPartitions(*keys, by)
    at = kept(rows.withColumn("_at", F.monotonically_increasing_id()), "counted").withColumn("_part", F.shiftright("_at", 33))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = at.groupBy(*keys, "_part").agg(F.sum(n).alias("_run"))
    runs = runs.select(*keys, "_part", before("_run", Window.partitionBy(*keys).orderBy("_part")).alias("_carried"))  # a row per task that a group spans
    own = before(n, Window.partitionBy(*keys, "_part").orderBy("_at"))  # a task's part of a group
    return joined(at, runs, [*keys, "_part"]).withColumn("_before", own + F.col("_carried")).drop("_at", "_part", "_carried")


def mean_ranked(df: DataFrame, keys: Sequence[str], by: Column, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the rank of ``by`` within the keys, from 1; equal values share the mean of their ranks.

    Values are counted before they are sorted, so ties cost one row; the rows
    of a common value stay dealt over many slots.  Null keys are a group of
    their own, null values come first, NaN last.
    """
    rows = kept(df.withColumns({"_by": by, "_slot": F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS)).cast("int")}), "to-rank")
    counts = rows.groupBy(*keys, "_by", "_slot").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys, "_by").agg(F.sum("_n").alias("n"), occupied().alias("_slots"))
    at = cumulative(counts, keys, "_by").select(*keys, "_by", (F.col("_before") + (F.col("n") + 1) / 2).alias(name), each_slot("_slots").alias("_slot"))
    return joined(rows, at, [*keys, "_by", "_slot"]).drop("_by", "_slot")


#: Points of the sketch of a group's values, and the sketch's accuracy: one in so many of the group's rows.
GRID, ACCURACY = 200, 2_000
#: Targets that are sent to all tasks; more are joined.
SENT = 10_000


def quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, fraction, value): exact quantiles of each column within each group, between two values by linear interpolation.

    Groups whose values fit a task are sorted there.  All others, and all their
    columns and fractions, are narrowed down together, see ``_narrowed``.
    Infinite values and NaN (the largest) are values like others; null is none,
    and a group without values has no row.  ``df`` is read two times or more.
    Without ``keys`` a large column's places are looked for by ``_placed``, in
    wide passes that neither unpivot nor join.
    """
    if not keys:
        n = df.agg(*[F.count(F.col(c).cast("double")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        if big := [(c, n[i]) for i, c in enumerate(columns) if n[i] > FEW]:
            found = _placed(df, dict(big), fractions)
            out = df.sparkSession.createDataFrame(found, "column string, fraction double, value double")
            few = [c for c in columns if c not in dict(big)]
            return out.unionByName(quantiles(df, few, fractions)) if few else out
    named, keys = list(keys), [f"_k{i}" for i in range(len(keys))]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c).cast("double") + 0.0).alias("v")) for c in columns]))
    values = df.select(*[F.col(c).alias(k) for c, k in zip(named, keys)], each.alias("_e")).select(*keys, "_e.column", "_e.v").filter("v IS NOT NULL")
    sizes = values.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n"))
    large = kept(sizes.filter(F.col("n") > FEW), "large-groups")
    few, found, at = values, None, [*keys, "column"]
    if n_large := large.count():
        names = {c: f"_t{c}" for c in at}
        targets = large.select(at).withColumnsRenamed(names)
        targets = F.broadcast(targets) if n_large <= SENT else targets
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(t)) for c, t in names.items()])
        few, many = values.join(targets, same, "left_anti"), values.join(targets, same, "left_semi")
        found = _narrowed(many, keys, fractions)
    out = few.groupBy(*at).agg(F.percentile("v", list(fractions)).alias("_v")).select(*at, F.explode(F.arrays_zip(F.array(*map(F.lit, fractions)).alias("f"), "_v")).alias("_q")).select(*at, F.col("_q.f").alias("fraction"), F.col("_q._v").alias("value"))
    out = out if found is None else out.unionByName(found)
    return out.select(*[F.col(k).alias(c) for c, k in zip(named, keys)], "column", "fraction", "value")


#: Accuracy of the sketch of a whole column, and values between two bounds that one task sorts.
FINE, AT_MOST = 10_000, 1_000_000


def _placed(df: DataFrame, sizes: dict[str, int], fractions: Sequence[float]) -> list[tuple[str, float, float]]:
    """(column, fraction, value) of whole columns with ``sizes`` values each; the driver gets a few figures per place.

    A pass sketches where the places lie, the next counts what lies below, at
    and between two values per place, a last one sorts what lies between, which
    is few; where it isn't, it is narrowed down in the same way.
    """
    value = {c: F.col(c).cast("double") + 0.0 for c in sizes}
    places = {(c, int((n - 1) * f) + up) for c, n in sizes.items() for f in fractions for up in (0, 1) if int((n - 1) * f) + up < n}
    # a place: the bounds it lies between, both outside, what lies between them, and its number there
    left = {p: (None, None, sizes[p[0]], p[1]) for p in places}
    found: dict[tuple[str, int], float] = {}

    def within(c, a, b):
        holds = value[c].isNotNull()
        holds = holds if a is None else holds & (value[c] > F.lit(a))
        return holds if b is None else holds & (value[c] < F.lit(b))

    def figures(columns):
        return list(df.agg(*[x.alias(f"x{i}") for i, x in enumerate(columns)]).first()) if columns else []

    while left:
        few = [p for p in left if left[p][2] <= AT_MOST]
        if few:
            near = reduce(lambda x, y: x | y, [within(p[0], *left[p][:2]) for p in few])
            runs = list(dict.fromkeys((p[0], *left[p][:2]) for p in few))
            lists = [F.sort_array(F.collect_list(F.when(within(*r), value[r[0]]))) for r in runs]
            at = [F.get(lists[runs.index((p[0], *left[p][:2]))], F.lit(left[p][3])) for p in few]
            for p, v in zip(few, df.filter(near).agg(*[x.alias(f"x{i}") for i, x in enumerate(at)]).first()):
                found[p] = v
                del left[p]
        many = list(left)
        spots = []
        for p in many:
            a, b, n, k = left[p]
            share = [min(max((k + 0.5) / n + d / FINE, 0.0), 1.0) for d in (-2, 2)]
            spots.append(F.percentile_approx(F.when(within(p[0], a, b), value[p[0]]), share, FINE))
        bounds = figures(spots)
        counts = []
        for p, (lo, hi) in zip(many, bounds):
            a, b, _, _ = left[p]
            inside, v = within(p[0], a, b), value[p[0]]
            counts += [F.count_if(inside & (v < F.lit(lo))), F.count_if(v == F.lit(lo)), F.count_if(inside & (v > F.lit(lo)) & (v < F.lit(hi))), F.count_if((v == F.lit(hi)) & (v > F.lit(lo)))]
        got = figures(counts)
        for i, (p, (lo, hi)) in enumerate(zip(many, bounds)):
            a, b, n, k = left[p]
            below, at_lo, mid, at_hi = got[4 * i : 4 * i + 4]
            if k < below:
                left[p] = (a, lo, below, k)
            elif k < below + at_lo:
                found[p] = lo
            elif k < below + at_lo + mid:
                left[p] = (lo, hi, mid, k - below - at_lo)
            elif k < below + at_lo + mid + at_hi:
                found[p] = hi
            else:
                left[p] = (hi, b, n - below - at_lo - mid - at_hi, k - below - at_lo - mid - at_hi)
            if p in found:
                del left[p]
    out = []
    for c, n in sizes.items():
        for f in fractions:
            at = (n - 1) * f
            x = found[c, int(at)]
            y = found.get((c, int(at) + 1), x)
            out.append((c, float(f), float(x if at == int(at) or x == y else x + (y - x) * (at - int(at)))))
    return out


def among_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], ids: Sequence[str], n: int, name: str) -> DataFrame:
    """``df`` with ``name``: whether a row is among the first ``n`` of its group; ``keys`` and ``ids`` together name a row.

    Each task keeps its own first ``n`` of a group, and only these move; the
    rows stay where they are.  ``order`` must leave no ties.  ``df`` is read twice.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    at = [*keys, *ids]
    first = df.withColumn("_nth", nth).filter(F.col("_nth") <= n).select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(at)], F.lit(True).alias("_in"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(at)])
    return df.join(first, same, "left").withColumn(name, F.col("_in").isNotNull()).drop("_in", *[f"_r{i}" for i in range(len(at))])


def _narrowed(values: DataFrame, keys: list[str], fractions: Sequence[float]) -> DataFrame:
    """(keys, column, fraction, value) from (keys, column, v).

    A pass counts what lies below, at and between two bounds per wanted place,
    and sketches what lies between for the next bounds, until few enough values
    are left for one task to sort.  A bound is a value that occurs, and each
    pass leaves it behind, so ties and infinite values end it too.
    """
    spots = [i / GRID for i in range(GRID + 1)]
    sketch = lambda v: F.percentile_approx(v, spots, ACCURACY)
    none = F.lit(None).cast("double")
    state = values.groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n"), sketch("v").alias("g"))
    state = state.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).withColumn("at", (F.col("n") - 1) * F.col("fraction"))
    state = state.withColumns({"k": F.floor("at"), "share": F.col("at") - F.floor("at"), "upper": F.explode(F.array(F.lit(False), F.lit(True)))}).filter("NOT upper OR share > 0")
    target = [*keys, "column", "fraction", "share", "upper"]  # a place; the upper one of two is the next
    state = kept(state.withColumn("k", F.col("k") + F.col("upper").cast("long")).select(*target, "k", none.alias("a"), none.alias("b"), "n", *_bounds(), none.alias("value")), "places")
    found = []
    while wanted := (left := state.filter("value IS NULL")).count():
        found.append(state.filter("value IS NOT NULL"))
        targets = left.withColumnsRenamed({c: f"_t{c}" for c in [*keys, "column"]}).drop("value")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in keys], F.col("column") == F.col("_tcolumn"))
        met = values.join(F.broadcast(targets) if wanted <= SENT else targets, same)
        k, v, lo, hi = F.col("k"), F.col("v"), F.col("lo"), F.col("hi")
        met = met.filter((F.col("a").isNull() | (v > F.col("a"))) & (F.col("b").isNull() | (v < F.col("b"))))
        between = (lo.isNull() | (v > lo)) & (hi.isNull() | (v < hi))
        # few enough values lie between the bounds, which are at most four points of the sketch apart
        small = (F.col("n") <= FEW) | ((F.col("n") <= FEW * GRID / 8) & (lo.isNotNull() | hi.isNotNull()))
        now = met.groupBy(*target, "k", "a", "b", "n", "lo", "hi").agg(
            F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if(between).alias("mid"), F.count_if((v == hi) & (lo.isNull() | (lo < hi))).alias("at_hi"),
            F.count_if((v > hi) & (lo.isNull() | (v > lo))).alias("above"), F.sort_array(F.collect_list(F.when(small & between, v))).alias("some"), sketch(F.when(~small & between, v)).alias("g"),
        )
        ends = [F.col("below")]
        for c in ("at_lo", "mid", "at_hi"):
            ends.append(ends[-1] + F.col(c))
        now = now.withColumn("part", F.when(k < ends[0], 0).when(k < ends[1], 1).when(k < ends[2], 2).when(k < ends[3], 3).otherwise(4))
        pick = lambda *of: F.when(F.col("part") == 0, of[0]).when(F.col("part") == 2, of[1]).otherwise(of[2])
        value = F.when(F.col("part") == 1, lo).when(F.col("part") == 3, hi).when((F.col("part") == 2) & small, F.get("some", (k - ends[1]).cast("int")))
        now = now.select(
            *target, pick(k, k - ends[1], k - ends[3]).alias("k"), pick(F.col("a"), F.coalesce(lo, "a"), hi).alias("a"), pick(lo, F.coalesce(hi, "b"), F.col("b")).alias("b"),
            pick(F.col("below"), F.col("mid"), F.col("above")).alias("n"), F.when(F.col("part") == 2, F.col("g")).alias("g"), value.alias("value"),
        )
        state = kept(now.select(*target, "k", "a", "b", "n", *_bounds(), "value"), "places")
    found = reduce(DataFrame.unionByName, found, state)
    one = lambda upper: F.max(F.when(F.col("upper") == upper, F.col("value")))
    out = found.groupBy(*keys, "column", "fraction", "share").agg(one(False).alias("x"), one(True).alias("y"))
    value = F.when(F.col("y").isNull() | (F.col("x") == F.col("y")), F.col("x")).otherwise(F.col("x") + (F.col("y") - F.col("x")) * F.col("share"))
    return out.select(*keys, "column", "fraction", value.alias("value"))


def _bounds() -> list[Column]:
    """The sketch's points on both sides of place ``k`` of ``n``, one apart for the sketch's error; null where there is none so far out, and without a sketch."""
    share = F.col("k") / F.greatest(F.col("n"), F.lit(1)) * GRID
    point = lambda i: F.when((i > 0) & (i < GRID) & F.col("g").isNotNull(), F.get("g", i.cast("int")))
    return [point(F.floor(share) - 1).alias("lo"), point(F.ceil(share) + 2).alias("hi")]


def median(df: DataFrame, column: str) -> float | None:
    """The exact median of a column, the mean of the middle two values if there is no middle one; None without values."""
    row = quantiles(df, [column], [0.5]).first()
    return None if row is None else row["value"]
