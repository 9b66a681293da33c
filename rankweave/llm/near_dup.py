"""Near-duplicate join on word shingles: a MinHash LSH forest, then exact verification.

1. Every text becomes the set of its shingles' hashes (five words each), and
   the set a MinHash signature.  Texts with equal sets share one set id.
2. The signature is cut into trees.  Per tree the sets are sorted by their
   whole row of hashes, which lays out the prefix trie: sets that share a
   prefix are neighbours.  One pass over the sorted rows compares the sets of
   each run of equal prefixes by short sketches of their whole signatures, and
   keeps a forest of the pairs that may be similar, each with the longest
   prefix at which a tree joins them.
3. The search starts with the trees' full depth.  Sets that are joined make
   candidate groups; every pair of a group is verified on the shingle sets.  A
   large group is dealt out as pairs of blocks, so no task ever gets a whole
   group, and only counts and a spanning forest leave a task.
4. While the recall is below the target for any similarity, prefixes are
   shortened, one tree after another, and the groups that grow by it are
   verified anew.  The similarities that count are those of the verified pairs
   and the threshold itself: a lone pair there can't be seen before it is met.
5. Verified links make the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, each_slot, fixed_bytes, fresh_names, from_fixed, in_few, occupied, slices, slot_of, written
from .ngrams import END, WordHashes, hashed_texts, mixed, word_hash

TREES, DEPTH = 16, 8
#: Bytes of a hash in a trie, of a set's id, and of the sketch of a whole signature.
HASH, SID, SKETCH = 2, 16, TREES * DEPTH // 4
#: Sets of a block; a task verifies the pairs of two blocks at most at a time.
BLOCK = 64
#: Rows of a run that are compared in the pass over the sorted rows; longer runs are dealt out in blocks of this size.
RUN = 256
#: Bins of similarity, from 0 to 1.
BINS = 100
#: Shingles that are worked on together, so that they stay in the processor's cache.
CACHED = 1 << 17
#: Bytes of text that are worked on together, about.
CHUNK_BYTES = 4_000_000


def chance_met(similarity: float, depths: list[int]) -> float:
    """The probability that a pair shares its prefix in some tree."""
    return 1.0 - float(np.prod([1.0 - similarity**d for d in depths]))


def matched_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which pairs of similarity ``threshold`` are met with probability ``recall`` or more."""
    while depth > 1 and chance_met(threshold, [depth] * trees) < recall:
        depth -= 1
    return depth


def shortened(depths: list[int], found: dict[int, int], threshold: float, recall: float) -> list[int]:
    """The prefix of each tree after as many steps as the target needs; each step takes one hash from the longest prefix.

    found: verified pairs by bin of similarity.  A bin's recall is estimated
    at its lower edge, or the threshold.  The threshold always counts, whatever
    was found: similar pairs elsewhere say nothing about a lone pair there.
    """
    edges = [threshold, *[max(threshold, b / BINS) for b, n in found.items() if n]]
    depths = list(depths)
    while min(chance_met(s, depths) for s in edges) < recall and max(depths) > 1:
        depths[depths.index(max(depths))] -= 1
    return depths


def least_agreement(threshold: float) -> int:
    """Hashes of a signature whose sketches agree, at least, for a pair at the threshold: 6.5 standard deviations below the mean.

    A sketch has two bits of each hash, so different hashes agree in one case of four.
    """
    n = TREES * DEPTH
    mean = threshold + (1 - threshold) / 4
    return max(0, int(n * mean - 6.5 * (n * mean * (1 - mean)) ** 0.5))


def shingle_sets(column: pa.Array, known: WordHashes, words: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a shorter text is one shingle, one without words has none."""
    tokens, lengths = hashed_texts(column, known)
    end = np.array([word_hash(END)], np.uint64)
    out, begin = [], 0
    for n in lengths.tolist():
        w = tokens[begin : begin + n - 1]
        begin += n
        k = min(words, len(w))
        if not k:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.repeat(end * np.uint64(k), len(w) - k + 1)
        for i in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)]
        out.append(np.unique(mixed(h)))
    return out


def _factors() -> np.ndarray:
    """Odd 64-bit multipliers, one per hash function, from a counter."""
    return mixed(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Per set: for each hash function two bytes of its least image, then the sketch; sets must not be empty.

    The sketch is one bit of each hash, then another bit of each.
    """
    factors = _factors()
    out = np.empty((len(sets), len(factors)), np.uint64)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    cuts = np.flatnonzero(np.diff(size.cumsum() // CACHED)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sets)]):
        flat = np.concatenate(sets[i:j])
        begin = size[i:j].cumsum() - size[i:j]
        for k, f in enumerate(factors):
            out[i:j, k] = np.minimum.reduceat(flat * f, begin)
    out = mixed(out)
    hashes = (out >> np.uint64(32)).astype(">u2").view(np.uint8).reshape(len(sets), -1)
    bits = [np.packbits((out >> np.uint64(k) & np.uint64(1)).astype(bool), axis=1) for k in (16, 17)]
    return np.concatenate([hashes, *bits], axis=1)


def _sketch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for part in slices(batches, "text", CHUNK_BYTES):
        sets = shingle_sets(part.column("text"), known, words)
        full = [s for s in sets if len(s)]
        signed = iter([x.tobytes() for x in signatures(full)] if full else [])
        ids = [None if not len(s) else np.array([s.sum(), mixed(s ^ np.uint64(0x2545F4914F6CDD1D)).sum()], np.uint64).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("h"), pa.array(ids, pa.binary()), pa.array([next(signed) if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "h", "sid", "sig"],
        )


def alike(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
    """Whether the sketches of rows i and j agree in ``least`` hashes or more."""
    half = sketch.shape[1] // 2
    differ = (sketch[i, :half] ^ sketch[j, :half]) | (sketch[i, half:] ^ sketch[j, half:])
    return np.bitwise_count(differ).sum(1) <= TREES * DEPTH - least


def joined(hashes: np.ndarray, i: np.ndarray, j: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest of the pairs (i, j) as edges (a, b, level): at each level the pairs that share so long a prefix connect the same rows."""
    level = np.cumprod(hashes[i] == hashes[j], axis=1).sum(1)
    label = np.arange(len(hashes))
    out = []
    for at in range(DEPTH, floor - 1, -1):
        p, q = i[level >= at], j[level >= at]
        new = label
        while True:
            least = np.minimum(new[p], new[q])
            low = new.copy()
            np.minimum.at(low, new[p], least)
            np.minimum.at(low, new[q], least)
            low = low[low]
            if (low == new).all():
                break
            new = low
        moved = np.flatnonzero((label == np.arange(len(label))) & (new != label))
        out.append((moved, new[moved], np.full(len(moved), at)))
        label = new
    return tuple(np.concatenate(x) for x in zip(*out))


def pairs_in_runs(run: np.ndarray, sketch: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of one run (equal numbers, side by side) whose sketches are alike."""
    end = np.searchsorted(run, run, side="right")
    at, step = np.arange(len(run)), 1
    first, second = [at[:0]], [at[:0]]
    while len(at := at[at + step < end[at]]):
        some = at[alike(sketch, at, at + step, least)]
        first.append(some)
        second.append(some + step)
        step += 1
    return np.concatenate(first), np.concatenate(second)


PASSED = "tree int, level int, a binary, b binary, key binary, sketch binary"


def _passed(tree: np.ndarray, level: np.ndarray | None, a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None, sketch: np.ndarray | None) -> pa.RecordBatch:
    n = len(tree)
    columns = [pa.array(tree, pa.int32()), pa.nulls(n, pa.int32()) if level is None else pa.array(level, pa.int32())]
    columns += [pa.nulls(n, pa.binary()) if x is None else from_fixed(x) for x in (a, b, key, sketch)]
    return pa.RecordBatch.from_arrays(columns, names=["tree", "level", "a", "b", "key", "sketch"])


def _trie(batches: Iterator[pa.RecordBatch], floor: int, least: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by tree and key: edges of the runs of equal prefixes of ``floor`` hashes.

    The rows of runs that are longer than RUN, or that may go on in another
    partition, are passed on as they are (b is null).
    """
    held: list[np.ndarray] | None = None  # tree, key, sid, sketch of the last run so far
    first = np.empty(0)

    def prefixes(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.concatenate([tree[:, None].astype(np.uint8), key[:, : HASH * floor]], axis=1)

    for batch in batches:
        if not len(batch):
            continue
        now = [batch.column("tree").to_numpy(), *(fixed_bytes(batch.column(c), w) for c, w in (("key", HASH * DEPTH), ("sid", SID), ("sketch", SKETCH)))]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        prefix = prefixes(now[0], now[1])
        if not len(first):
            first = prefix[0]
        starts = np.append(True, (prefix[1:] != prefix[:-1]).any(1))
        run = starts.cumsum() - 1
        size = np.bincount(run)
        done = run < run[-1]
        held = [x[~done] for x in now]
        far = (size[run] > RUN) | (prefix == first).all(1)
        if (long := done & far).any():
            yield _passed(now[0][long], None, now[2][long], None, now[1][long], now[3][long])
        if len(held[0]) > RUN:  # of a run that goes on, only the last row is kept back: the rest follows as a long run
            yield _passed(held[0][:-1], None, held[2][:-1], None, held[1][:-1], held[3][:-1])
            first, held = prefix[-1], [x[-1:] for x in held]
        near = done & ~far & (size[run] > 1)
        if near.any():
            tree, key, sid, sketch = (x[near] for x in now)
            i, j = pairs_in_runs(run[near], sketch, least)
            a, b, level = joined(key.reshape(len(key), DEPTH, HASH).view(">u2")[:, :, 0], i, j, floor)
            yield _passed(tree[a], level, sid[a], sid[b], None, None)
    if held is not None:
        yield _passed(held[0], None, held[2], None, held[1], held[3])


def _long_run(floor: int, least: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Edges of two blocks of one run."""

    def work(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        block = group.column("block").to_numpy()
        hashes = fixed_bytes(group.column("key").chunk(0), HASH * DEPTH).reshape(len(group), DEPTH, HASH).view(">u2")[:, :, 0]
        sid, sketch = fixed_bytes(group.column("a").chunk(0), SID), fixed_bytes(group.column("sketch").chunk(0), SKETCH)
        i, j = pairs_in_runs(np.zeros(len(group), np.int64), sketch, least)
        if key[2].as_py() != key[3].as_py():
            across = block[i] != block[j]
            i, j = i[across], j[across]
        a, b, level = joined(hashes, i, j, floor)
        return pa.Table.from_batches([_passed(np.full(len(a), key[0].as_py()), level, sid[a], sid[b], None, None)])

    return work


def candidate_edges(sets: DataFrame, floor: int, least: int) -> DataFrame:
    """(tree, level, a, b): pairs of ``sets`` that a tree joins at prefixes of ``level`` hashes, ``floor`` at least.

    A run of m sets that is dealt out costs m² / RUN transfers of a row of 66
    bytes; texts stay where they are.
    """
    keyed = sets.select("sid", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig")
    width, all_hashes = HASH * DEPTH, HASH * DEPTH * TREES
    keyed = keyed.select("tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("key"), "sid", F.expr(f"substring(sig, {all_hashes + 1}, {SKETCH})").alias("sketch"))
    order = ["tree", "key", "sid"]
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    passed = written(rows.mapInArrow(lambda it: _trie(it, floor, least), PASSED), "trie")

    long = passed.filter("b IS NULL").withColumn("prefix", F.substring("key", 1, HASH * floor)).withColumn("slot", slot_of("a"))
    # an unbroken run of rows may be counted without its rows meeting in a task
    of_run = long.groupBy("tree", "prefix", "slot").agg(F.count("*").alias("n")).groupBy("tree", "prefix").agg(F.sum("n").alias("n"), occupied("slot").alias("slots"))
    of_run = of_run.filter("n > 1").select("tree", "prefix", F.ceil(F.col("n") / RUN).cast("int").alias("blocks"), each_slot("slots").alias("slot"))
    dealt = long.join(of_run, ["tree", "prefix", "slot"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tree", "prefix", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "a", "key", "sketch")
    far = dealt.groupBy("tree", "prefix", "i", "j").applyInArrow(_long_run(floor, least), PASSED)
    edges = passed.filter("b IS NOT NULL").select("tree", "level", "a", "b").unionByName(far.select("tree", "level", "a", "b"))
    return written(edges, "candidates")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the least node of its component.

    Rounds of large star and small star; each is written out, and the rounds
    end when every component is a star around its least node.  The edges of a
    node with many neighbours stay dealt over SLOTS slots.
    """

    def oriented(e: DataFrame) -> DataFrame:
        return e.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    def settled(e: DataFrame) -> bool:
        """Whether no node has two lower neighbours, or a lower and a higher one."""
        ends = e.select("a", F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("low"), F.lit(1).alias("high")))
        each = ends.groupBy("a").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
        return few(each.filter("low > 1 OR low = 1 AND high = 1")).isEmpty()

    now = written(oriented(edges).distinct(), "edges")
    n = now.count()  # no round makes more edges
    few = lambda df: in_few(df, 2 * n)
    for _ in range(most_rounds):
        if settled(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("slot", slot_of("b"))
        least = few(few(both.groupBy("a", "slot").agg(F.min("b").alias("m"))).groupBy("a").agg(F.min("m").alias("m"), occupied("slot").alias("slots")))
        least = least.select("a", F.least("a", "m").alias("m"), each_slot("slots").alias("slot"))
        large = written(few(oriented(both.filter("b > a").join(least, ["a", "slot"]).select(F.col("b").alias("a"), F.col("m").alias("b")))), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = written(few(few(oriented(small)).distinct()), "small-star")
    else:
        raise RuntimeError("components did not settle")
    return few(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each pair of sets has in common."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1  # an element of one set alone is in no pair's common part
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((m, m), np.float64)
    step = 8192
    for c in range(0, int(often.sum()), step):
        i, j = np.searchsorted(column, [c, c + step])
        x = np.zeros((m, step), np.float32)
        x[row[i:j], column[i:j] - c] = 1
        out += x @ x.T
    return out


LINKS = "root binary, members long, slot int, sid binary, least binary, links long, bin int, pairs long"


def _verify(threshold: float) -> Callable[[tuple, pa.Table], pa.Table]:
    """Links of two blocks of a group: per set its number of links and the least set that is reached; and, with a bin, how many pairs have that similarity."""

    def work(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        ids, block = group.column("sid").to_pylist(), np.array(group.column("block").to_pylist())
        slot = group.column("slot").to_pylist()
        copies = np.array(group.column("copies").to_pylist(), np.int64)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
        size = np.array([len(s) for s in sets], np.float64)
        common = _shared(sets)
        either = size[:, None] + size[None] - common
        linked = common >= threshold * either - 1e-9
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block[None]
        links = linked @ copies
        label = np.argsort(np.argsort(np.array(ids, dtype=object)))
        while True:  # every set takes the least label among its neighbours'
            least = np.where(linked, label[None], len(ids)).min(1, initial=len(ids))
            new = np.minimum(label, least)
            if (new == label).all():
                break
            label = new
        by_label = sorted(ids)
        some = np.flatnonzero(links)
        upper = np.triu(linked)
        bins = np.bincount(np.minimum(common[upper] / either[upper] * BINS + 1e-9, BINS).astype(int), minlength=BINS + 1)
        used = np.flatnonzero(bins)
        root, members = key[0].as_py(), group.column("members")[0].as_py()
        n, extra = len(some) + len(used), len(used)
        return pa.table({
            "root": pa.array([root] * n, pa.binary()),
            "members": pa.array([members] * n, pa.int64()),
            "slot": pa.array([slot[k] for k in some] + [slot[0]] * extra, pa.int32()),
            "sid": pa.array([ids[k] for k in some] + [ids[0]] * extra, pa.binary()),
            "least": pa.array([by_label[label[k]] for k in some] + [ids[0]] * extra, pa.binary()),
            "links": pa.array(links[some].tolist() + [0] * extra, pa.int64()),
            "bin": pa.array([None] * len(some) + used.tolist(), pa.int32()),
            "pairs": pa.array([0] * len(some) + bins[used].tolist(), pa.int64()),
        })

    return work


def _verified(rows: DataFrame, members: DataFrame, words: int, threshold: float) -> DataFrame:
    """The links of groups: ``members`` has sid, root, members, slot, key, h and copies; ``rows`` has key, h and text.

    A group of m sets costs m² / BLOCK transfers of a set of shingles.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    one = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key", "h").orderBy(F.lit(0)))).filter("nth = 1").drop("nth")
    names = ["sid", "root", "members", "slot", "blocks", "block", "copies"]
    texts = one.join(dealt, ["key", "h"]).select(*names, "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in slices(batches, "text", CHUNK_BYTES):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"), known, words)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(sets, pa.binary())], names=[*names, "shingles"])

    sets = texts.mapInArrow(shingled, "sid binary, root binary, members long, slot int, blocks int, block int, copies long, shingles binary")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return written(sets.groupBy("root", "i", "j").applyInArrow(_verify(threshold), LINKS), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, kept; ``how`` may set words, threshold and recall.

    n_links: the other rows whose shingle set has Jaccard similarity
    ``threshold`` or more to this row's, copies counted.  class_id: the least
    doc_id that is reached over links; kept: whether the row is the one of its
    class that stays (that least doc_id; of rows that share it, the one whose
    text has the least hash; of repeated rows, one).  Words are split at ASCII
    white space after lower-casing A-Z.  A null text or one without words has
    no links and a class of its own, and stays.  A class has a null id only
    if all its ids are null.  An empty table gives an empty result.  A text is
    worked on whole: a task needs about 30 bytes for each of its words.
    """
    out = decided(docs, id_col, text_col, **how)
    rest = out.filter("alone OR NOT stays").select("doc_id", "class_id", "n_links", F.col("stays").alias("kept"))
    # rows that repeat the one that stays are counted, not gathered
    top = out.filter("stays AND NOT alone").groupBy("doc_id", "h", "class_id", "n_links").agg(F.count("*").alias("same"))
    top = top.select("doc_id", "class_id", "n_links", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))).alias("nth"))
    return rest.unionByName(top.select("doc_id", "class_id", "n_links", (F.col("nth") == 1).alias("kept")))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def key_of(id_column: Column) -> Column:
    """An id as a value that joins and windows alike can use as key, so that they share one shuffle; null has its own."""
    return F.coalesce(id_column.cast("string"), F.lit(""))


def searched(rows: DataFrame, sets: DataFrame, words: int, threshold: float, recall: float) -> DataFrame:
    """All verified links among ``sets``: from the full depth of the trees on, prefixes are shortened until the estimated recall meets the target."""
    edges = candidate_edges(sets, matched_depth(threshold, recall), least_agreement(threshold))
    known = sets.select(F.col("sid").alias("node"), key_of(F.col("doc_id")).alias("key"), "h", "copies")
    depths, links, settled = [DEPTH] * TREES, None, None
    while True:
        met = edges.filter(F.col("level") >= F.element_at(F.array(*map(F.lit, depths)), F.col("tree") + 1)).select("a", "b")
        groups = written(components(met).withColumn("slot", slot_of("node")), "groups")
        n = groups.count()
        sizes = in_few(groups.groupBy("root", "slot").agg(F.count("*").alias("n")), n).groupBy("root").agg(F.sum("n").alias("members"), occupied("slot").alias("slots"))
        sizes = written(in_few(sizes, n), "group-sizes")
        # a group that has not grown since was verified before
        grown = sizes if settled is None else sizes.join(settled, ["root", "members"], "left_anti")
        grown = grown.select("root", "members", each_slot("slots").alias("slot"))
        members = groups.join(grown, ["root", "slot"]).join(known, "node").withColumnRenamed("node", "sid")
        fresh = _verified(rows, members, words, threshold)
        if links is not None:
            still = sizes.select("root", "members", each_slot("slots").alias("slot"))
            fresh = written(links.join(still, ["root", "members", "slot"], "left_semi").unionByName(fresh), "links")
        links, settled = fresh, sizes
        found = {r["bin"]: r["n"] for r in links.filter("bin IS NOT NULL").groupBy("bin").agg(F.sum("pairs").alias("n")).collect()}  # BINS rows at most
        if (shorter := shortened(depths, found, threshold, recall)) == depths:
            return links
        depths = shorter


def decided(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row per row of ``docs``: doc_id, h (the text's hash), class_id, n_links, stays, alone (no link and no copy).

    Rows that repeat the one that stays all have ``stays``.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).withColumn("h", text_hash(F.col("text")))
    kind = docs.schema[id_col].dataType.simpleString()
    sketched = written(rows.mapInArrow(lambda it: _sketch(it, words), f"doc_id {kind}, h long, sid binary, sig binary").withColumn("slot", slot_of("doc_id", "h")), "sketches")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h"))
    parts = sketched.filter("sid IS NOT NULL").groupBy("sid", "slot").agg(first.alias("first"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    sets = parts.groupBy("sid").agg(F.min("first").alias("first"), F.sum("copies").alias("copies"), F.first("sig").alias("sig"), occupied("slot").alias("slots"))
    sets = written(sets.select("sid", "first.doc_id", "first.h", "copies", "sig", "slots"), "sets")

    verified = searched(rows.select(key_of(F.col("doc_id")).alias("key"), "h", "text"), sets, words, threshold, recall)
    links = verified.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = components(verified.select(F.col("sid").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("sid"), "root")
    known = sets.select("sid", "doc_id", "h", "copies", "slots").join(links, "sid", "left").join(classes, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    known = written(known.filter("copies > 1 OR links > 0").withColumn("slot", slot_of("sid")), "linked")
    best = known.groupBy("root", "slot").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h")).alias("best"))
    best = best.groupBy("root").agg(F.min("best").alias("best"), occupied("slot").alias("spread")).select("root", "best", each_slot("spread").alias("slot"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    known = known.join(best, ["root", "slot"]).select("sid", F.col("best.doc_id").alias("class_id"), F.col("best.h").alias("best_h"), n_links, each_slot("slots").alias("slot"))
    known = written(known, "classes")

    out = sketched.select("doc_id", "h", "sid", "slot").join(known, ["sid", "slot"], "left")
    alone = F.col("n_links").isNull()
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("best_h")))
    return out.select("doc_id", "h", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), stays.alias("stays"), alone.alias("alone"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` of which ``near_duplicates`` keeps one per class, with all their columns; rows without words all stay."""
    out = decided(docs.select(f"`{id_col}`", f"`{text_col}`"), id_col, text_col, **how)
    key, h, nth = fresh_names(docs.columns, "key", "h", "nth")
    gone = out.filter("NOT stays").select(key_of(F.col("doc_id")).alias(key), F.col("h").alias(h)).distinct()
    rows = docs.withColumns({key: key_of(F.col(f"`{id_col}`")), h: text_hash(F.col(f"`{text_col}`"))}).join(gone, [key, h], "left_anti")
    rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy(key, h).orderBy(F.lit(0))))
    rows = rows.filter((F.col(nth) == 1) | ~F.coalesce(F.col(f"`{text_col}`"), F.lit("")).rlike(WORD))
    return rows.select([F.col(f"`{c}`") for c in docs.columns])
