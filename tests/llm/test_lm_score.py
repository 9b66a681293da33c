import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rankweave.llm import lm_score
from rankweave.llm.ngrams import discounts

END, START = ("end",), ("start",)


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [END]


class Plain:
    """The same model, over plain dictionaries."""

    def __init__(self, texts):
        self.count, pairs = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.count.update(w)
            pairs.update(zip([START, *w], w))
        self.pairs, self.n, self.v = pairs, sum(self.count.values()), len(self.count)
        self.total, self.ranks = Counter(), defaultdict(lambda: [0, 0, 0])
        self.follow = Counter()
        for (a, b), c in pairs.items():
            self.total[a] += c
            self.ranks[a][min(c, 3) - 1] += 1
            self.follow[b] += 1
        of = lambda values: [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        self.high = (0, *discounts(*of(pairs.values())))
        self.low = (0, *discounts(*of(self.follow.values())))

    def word(self, w):
        spare = sum(self.low[min(c, 3)] for c in self.follow.values()) / max(len(self.pairs), 1) if self.pairs else 1
        c = self.follow[w]
        return max(c - self.low[min(c, 3)], 0) / max(len(self.pairs), 1) + spare / (self.v + 1)

    def pair(self, a, b):
        if not self.total[a]:
            return self.word(b)
        c = self.pairs[a, b]
        spare = sum(d * n for d, n in zip(self.high[1:], self.ranks[a])) / self.total[a]
        return max(c - self.high[min(c, 3)], 0) / self.total[a] + spare * self.word(b)

    def score(self, text):
        w = tokens(text)
        base = sum(math.log10((self.count[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        return len(w), sum(self.count[x] > 0 for x in w), self.n, base, sum(math.log10(self.pair(a, b)) for a, b in zip([START, *w], w))


def texts(n, seed):
    r = random.Random(seed)
    words = ["The", "the", "of", "Éa", "a\x1cb", "x"] + [f"w{i}" for i in range(80)]
    out = [" ".join(r.choices(words, weights=[40, 30, 20, 10, 5, 300] + [2] * 80, k=r.randrange(0, 60))) for _ in range(n)]
    return out + [None, "", "  \n\t ", "x x x", "x x x", "w1 " * 4000]


def check(spark, learned, scored):
    model = lm_score.train(spark.createDataFrame([(i, t) for i, t in enumerate(learned)], "doc_id long, text string"))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(scored)], "doc_id long, text string, total string")
    got = {r["doc_id"]: r for r in lm_score.score(docs, model, keep=["doc_id", "total"]).collect()}
    plain = Plain(learned)
    assert len(got) == len(scored)
    for i, t in enumerate(scored):
        want = plain.score(t)
        assert [got[i][c] for c in ("n_tokens", "n_known", "train_tokens")] == list(want[:3])
        assert got[i]["base_score"] == pytest.approx(want[3], rel=1e-9, abs=1e-9)
        assert got[i]["score"] == pytest.approx(want[4], rel=1e-5, abs=1e-5)


def test_against_plain_dictionaries(spark):
    learned = texts(120, 1)
    check(spark, learned, learned + texts(40, 2) + ["never met before", "x never x"])


def test_probabilities_add_up_to_one():
    plain = Plain(texts(60, 3))
    for a in ["x", "w3", START]:
        assert sum(plain.pair(a, b) for b in plain.count) + plain.pair(a, "unknown") == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    check(spark, [], ["a b", None])


def test_no_texts(spark):
    model = lm_score.train(spark.createDataFrame([("a b",)], "text string"))
    assert lm_score.score(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_frequent_pairs_pass_the_small_counter(spark):
    check(spark, ["x x x x x x"] * 100 + ["y"], ["x x", "y x", "x y"])


def test_repeated_rows_and_refused_names(spark):
    model = lm_score.train(spark.createDataFrame([("a b c",), ("a b d",)], "text string"))
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)], "doc_id long, text string")
    got = lm_score.score(docs, model).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["text"]}) == 1
    with pytest.raises(ValueError):
        lm_score.score(docs.withColumnRenamed("doc_id", "N_Known"), model)


def test_arrays_that_cannot_be_mapped_are_read_and_dropped_again(tmp_path, monkeypatch):
    paths = [str(tmp_path / str(i)) for i in range(4)]
    for i, p in enumerate(paths):
        lm_score.write_array(p, np.full(100, i, np.uint64))
    monkeypatch.setattr(lm_score.pafs, "LocalFileSystem", type(None))  # as in a remote store
    monkeypatch.setattr(lm_score, "KEPT_BYTES", 1700)
    for _ in range(2):
        for i, p in enumerate(paths):
            assert (lm_score.map_array(p, np.uint64) == i).all()
            assert len(lm_score._kept) <= 2
    lm_score._kept.clear()


def test_too_many_words_for_a_pair_key(spark, monkeypatch):
    monkeypatch.setattr(lm_score.Model, "words", property(lambda self: 1 << 32))
    with pytest.raises(OverflowError):
        lm_score.train(spark.createDataFrame([("a b c",)], "text string"))
