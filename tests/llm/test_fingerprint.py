import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from rankweave.llm import fingerprint


def plain_rows(rows):
    """Distinct (id, text) in the order of descending id; only where ids are distinct is the order known."""
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(order):
        head = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        out[i] = (len(t), hashlib.sha256((t[: len(t) - n] + head[:n]).encode()).hexdigest(), order[(k + 1) % len(order)][0])
    return out


def plain_simhash(text):
    """Each pair of adjacent words (the last word alone) votes on 64 bits with its characters."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    votes, every = Counter(), 0
    for k, a in enumerate(words):
        b = words[k + 1] if k + 1 < len(words) else None
        x = xxhash.xxh64_intdigest(a.encode(), 42)
        x = x if b is None else xxhash.xxh64_intdigest(b.encode(), x)  # Spark's hash of two columns
        weight = len(a) + len(b or "")
        every += weight
        for bit in range(64):
            votes[bit] += weight * (x >> bit & 1)
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > every)


def plain_edited(rows):
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return {i: t[: len(t) - len(t) // 3] + order[(k + 1) % len(order)][1][: len(t) // 3] for k, (i, t) in enumerate(order)}


def test_against_plain_fingerprints(spark):
    r = random.Random(7)
    words = ["É" * 3, "ab", "x", "a-very-long-word-of-more-than-thirty-two-characters", "日本", "🎉"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(0, 60)))) for i in range(150)] + [(200, None), (201, " \t\n"), (202, "one"), (203, "A a"), (204, "b " * 20_000)]
    edited = plain_edited(rows)
    got = {x["doc_id"]: x for x in fingerprint.fingerprinted(frame(spark, rows)).collect()}
    for i, t in rows:
        assert int(got[i]["fingerprint"], 16) == plain_simhash(t or ""), (i, t)
        assert int(got[i]["edited_fingerprint"], 16) == plain_simhash(edited[i])


def test_half_of_all_rows_share_a_fingerprint(spark):
    rows = [(i, "the same text" if i % 2 == 0 else f"a text of its own {i}") for i in range(400)]
    got = {x["doc_id"]: x for x in fingerprint.fingerprinted(frame(spark, rows)).collect()}
    assert len(got) == 400 and {got[i]["within_radius"] for i in range(0, 400, 50)} == {200}
    assert all(x["within_radius"] is None for i, x in got.items() if i % 50)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).repartition(5)


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_edits_and_search(spark):
    r = random.Random(5)
    words = [f"w{i}é" for i in range(400)]
    rows = [(i * 7, " ".join(r.choices(words, k=r.randrange(0, 90)))) for i in range(120)]
    rows += [(1000, rows[3][1]), (1050, rows[3][1] + " x"), (1, None), (2, ""), (5000, "long " * 5000), (None, "no id")]
    got = {x["doc_id"]: x for x in fingerprint.fingerprinted(frame(spark, rows)).collect()}
    want = plain_rows(rows)
    assert set(got) == set(want)
    for i, (n, sha, after) in want.items():
        g = got[i]
        assert (g["n_chars"], g["edited_sha256"]) == (n, sha)
        assert g["near_next"] == 1 - distance(g["fingerprint"], got[after]["fingerprint"]) / 64
        assert g["near_edited"] == 1 - distance(g["fingerprint"], g["edited_fingerprint"]) / 64
        near = sum(distance(g["fingerprint"], got[j]["fingerprint"]) <= 3 for j in got)
        assert g["within_radius"] == (near if i is not None and i % 50 == 0 else None)
    assert got[1000]["fingerprint"] == got[21]["fingerprint"] and got[1]["fingerprint"] == got[2]["fingerprint"]


def test_masks_meet_every_pair_within_the_radius():
    masks = fingerprint.block_masks(3)
    r = random.Random(1)
    for _ in range(300):
        x = sum(1 << b for b in r.sample(range(64), 3))
        assert any(not x & m & ((1 << 64) - 1) for m in masks)


def test_repeated_rows_and_small_tables(spark):
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (3, "x y z")]
    got = fingerprint.fingerprinted(frame(spark, rows)).collect()
    assert sorted(x["doc_id"] for x in got) == [3, 4, 4]
    assert len({tuple(x) for x in got if x["doc_id"] == 4}) == 1
    alone = fingerprint.fingerprinted(frame(spark, [(9, "abcdef")])).collect()
    assert alone[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone[0]["near_next"] == 1
    assert fingerprint.fingerprinted(frame(spark, [])).collect() == []
