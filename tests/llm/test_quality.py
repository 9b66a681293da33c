import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankweave.llm import quality
from rankweave.llm.ngrams import discounts

from .test_lm_score import START, Plain, texts, tokens


class PlainGrams:
    """The same model of any order, over plain dictionaries."""

    def __init__(self, learned, order):
        self.order = order
        full = Counter()
        begins = defaultdict(Counter)
        for t in learned:
            w = [START, *tokens(t)]
            full.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
            for n in range(2, order):
                if len(w) >= n:
                    begins[n][tuple(w[:n])] += 1
        self.counts = {order: full}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(x[1:] for x in self.counts[n + 1])
            self.counts[n].update(begins[n])
        of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
        self.cut = {n: (0, *discounts(*of(c))) for n, c in self.counts.items()}
        self.total, self.spare = defaultdict(Counter), defaultdict(Counter)
        for n, c in self.counts.items():
            for x, k in c.items():
                self.total[n][x[:-1]] += k
                self.spare[n][x[:-1]] += self.cut[n][min(k, 3)]

    def p(self, gram):
        n = len(gram)
        rest = self.p(gram[1:]) if n > 1 else 1 / (len(self.counts[1]) + 1)
        total = self.total[n][gram[:-1]]
        if not total:
            return rest
        c = self.counts[n][gram]
        return (c - self.cut[n][min(c, 3)]) / total + self.spare[n][gram[:-1]] / total * rest

    def perplexity(self, text):
        w = [START, *tokens(text)]
        logs = [math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(w))]
        return 10 ** (-sum(logs) / len(logs))


def check(spark, learned, scored, order=3):
    model = quality.fit(spark.createDataFrame([(t,) for t in learned], "text string").repartition(3), order=order)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(scored)], "doc_id long, text string")
    names = ["k", "l", "part", "_k", "_copies", "copies", "row", "_text", "salt"]
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names]).repartition(3)
    got = {r["doc_id"]: r for r in quality.perplexity(docs, model, keep=["doc_id", *names]).collect()}
    plain = PlainGrams(learned, order)
    assert len(got) == len(scored)
    for i, t in enumerate(scored):
        assert got[i]["n_tokens"] == len(tokens(t)) and all(got[i][n] == f"{n}:{i}" for n in names)
        assert got[i]["perplexity"] == pytest.approx(plain.perplexity(t), rel=1e-6)


@pytest.mark.parametrize("order", [2, 3])
def test_against_plain_dictionaries(spark, order):
    learned = texts(120, 1)
    check(spark, learned, learned + texts(40, 2) + ["never met before", "x never x"], order)


def test_order_two_is_the_bigram_model():
    learned = texts(60, 5)
    plain, grams = Plain(learned), PlainGrams(learned, 2)
    for t in learned:
        assert grams.perplexity(t) == pytest.approx(10 ** (-plain.score(t)[4] / len(tokens(t))))


def test_nothing_to_learn_from(spark):
    check(spark, [], ["a b", None])


def test_repeated_rows_and_null_ids(spark):
    model = quality.fit(spark.createDataFrame([("a b c",), ("a b d",)], "text string"))
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, "a b a b")], "doc_id long, text string")
    got = quality.perplexity(docs, model).collect()
    assert len(got) == 5
    assert len({round(r["perplexity"], 9) for r in got if r["text"] == "a b"}) == 1


def test_thresholds_by_language(spark):
    r = texts(200, 3)[:200]
    docs = [(i, t, "en" if i % 2 else None) for i, t in enumerate(r)] + [(900, "zq zw ze zr zt zy zu zi", "en"), (901, "zq zw", "xx")]
    labels = [(i, 1, 0) for i in range(200)] + [(5, 0, 0), (900, 0, 1), (None, 1, 0)]
    out = quality.classified(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x["doc_id"]: x for x in out.collect()}
    assert len(got) == len(docs)
    assert not got[900]["kept"] and got[901]["kept"] and got[901]["threshold"] is None
    assert sum(not got[i]["kept"] for i in range(200)) <= 6
    limits = {x["lang"]: x["threshold"] for x in got.values()}
    assert limits["en"] and limits[None] and limits["en"] != limits[None]
    for x in got.values():
        assert x["kept"] == (x["threshold"] is None or x["perplexity"] <= x["threshold"])


def test_all_but_the_judges_of_ten_thousand_trusted_rows_are_learned(spark):
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") % 2 == 0, "en").alias("lang"))
    learn, judges = quality.trusted_parts(rows)
    assert learn.count() + judges(rows).count() == 10_000 and learn.count() > 7_500


def test_every_language_with_trusted_rows_has_a_threshold(spark):
    docs = [(i, f"word{i} of text", f"l{i}") for i in range(30)] + [(100, "another", "none")]
    out = quality.classified(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int"))
    got = {x["lang"]: x for x in out.collect()}
    assert len(got) == 31 and all((x["threshold"] is None) == (lang == "none") for lang, x in got.items())
    assert all(x["kept"] for x in got.values())  # ties with the threshold among them, were the slack 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.classified(docs.limit(0), labels).count() == 0
    assert [x["kept"] for x in quality.classified(docs, labels).collect()] == [True]
