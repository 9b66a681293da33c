"""Exact dedup, mixing, BPE, WARC, language ID and PII against plain versions, with nulls, ties, repeats and empty tables."""

import base64
import gzip
import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict
from datetime import date

import public_tokenizers
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import bpe, exact_dedup, langid, mixing, pii, warc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "clash") for i, t, lang, s in rows], DOCS).repartition(3)


def test_exact_dedup(spark):
    r = random.Random(1)
    texts = ["", None, "ÀB", "àB", "ab", "AB", "x" * 9000, "\t"] + [f"t{i}" for i in range(40)]
    rows = [(i if i % 17 else None, r.choice(texts) if i % 3 else "hot Text", "en", "s") for i in range(600)] + [(5000, "rep", "en", "s")] * 3
    out = exact_dedup.duplicate_groups(frame(spark, rows), max_heavy=20).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()].append(i)
    assert Counter((x["doc_id"], x["text_sha256"]) for x in out) == Counter((i, h) for h, ids in groups.items() for i in ids)
    for x in out:
        ids = groups[x["text_sha256"]]
        assert x["group_size"] == len(ids) and x["keep_id"] == max((i for i in ids if i is not None), default=None)
    kept = Counter(x["text_sha256"] for x in out if x["kept"])
    assert set(kept.values()) == {1} and set(kept) == set(groups)
    left = exact_dedup.drop_duplicates(frame(spark, rows))
    assert left.count() == len(groups) and left.columns == ["doc_id", "text", "lang", "source", "keep_id"]
    assert exact_dedup.duplicate_groups(frame(spark, [])).collect() == []


def test_columns_with_the_names_used_inside(spark):
    names = ["_id", "_source", "_words", "_turn", "_nth", "copies", "_copies", "_copy", "_size", "_digest", "_kept_id", "_kept_digest", "__id", "slot", "size", "target", "digest", "class"]
    rows = [(i, "a b c" if i % 3 else f"text {i}", "s" if i % 2 else None) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in names]).repartition(3)
    whole = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for out in (exact_dedup.drop_duplicates(docs), mixing.mixed(docs)):
        assert out.columns == docs.columns
        found = out.collect()
        assert found and all(tuple(r) == whole[r["doc_id"]] for r in found)


def plain_targets(sizes):
    total, target, stopped = 1.5 * sum(sizes.values()), {}, set()
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(2 * sizes[s] for s in stopped)
        w = sum(weight[s] for s in free)
        target = {s: 2 * sizes[s] if s in stopped else rest * weight[s] / w for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        stopped |= over


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 3, 20, 200])), "en", r.choice(["a", "b", "c", "Z", None, "é"])) for i in range(900)] + [(1, None, "en", "empty"), (None, "a b", "en", "a"), (7, "a b", "en", "a")]
    out = mixing.taken_copies(frame(spark, rows)).collect()
    sizes, taken = Counter(), Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want = plain_targets(dict(sizes))
    assert len(out) == len(rows)
    for x in out:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(want[x["source"]])
        assert x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 200
    again = mixing.taken_copies(frame(spark, rows[::-1])).collect()
    key = lambda x: (str(x["doc_id"]), x["size"], x["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    mixed = mixing.mixed(frame(spark, rows)).collect()
    assert sum(len((x["text"] or "").split()) for x in mixed) == sum(taken.values())
    assert mixing.taken_copies(frame(spark, [])).collect() == []


def test_bpe_round_trip_with_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    r = random.Random(3)
    letters = "aaabcdeéßΣİ日🎉 \n\t'.,12½<|>"
    texts = ["", None, "  ", "<|startoftext|>Hello<|endoftext|>  world's", "<|ENDOFTEXT|>", "ΣΑΣ", "a" * 3000, "a\x1cb\x85c d", "é ́x"] + ["".join(r.choices(letters, k=r.randrange(80))) for _ in range(150)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    coded = bpe.encode(docs, path, keep=["doc_id", "keep_id"])
    ids = {x["doc_id"]: x["ids"] for x in coded.collect()}
    back = {x["doc_id"]: x["decoded"] for x in bpe.decode(coded, path).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids[i] == want and back[i] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(frame(spark, []), path, keep=["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumn("ids", F.lit(1)), path)


def test_warc_round_trip(spark, tmp_path):
    html = ["", None, "a\r\n\r\nb", "a\r\n", "\r\n\r\r\n\r\n\r\n", "é" * 50, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "\n", "long" * 4000]
    r = random.Random(4)
    rows = [(i, f"http://h/{i} x", r.choice(html), "clash") for i in range(60)] + [(None, None, "é" * 50, "clash"), (None, "u", "only", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(4)
    out = warc.archived(pages, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h, _ in rows:
        data = (h or "").encode()
        again = (h or "") in first and first[h or ""] != i
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in out) == want
    small = warc.archived(pages, str(tmp_path / "c"), str(tmp_path / "d"), least_bytes=10).collect()
    assert all(x["record_type"] == "response" for x in small if x["payload_bytes"] < 10)
    assert warc.archived(pages.limit(0), str(tmp_path / "e"), str(tmp_path / "f")).count() == 0
    # any gzip tool reads the archives; every member is one record with the page's bytes
    held = Counter()
    for path in (tmp_path / "b").glob("*"):
        assert path.name.endswith(".warc.gz")
        plain = gzip.decompress(path.read_bytes())
        with pafs.LocalFileSystem().open_input_stream(str(path), compression=None) as f:
            records = [warc.parsed(data) for _, _, data in warc.members(f)]
        assert records[0][0]["warc-type"] == "warcinfo" and plain.count(b"WARC-Record-ID: ") == len(records)
        held.update(block.partition(warc.END)[2] for named, block in records if named["warc-type"] == "response")
    assert held == Counter((h or "").encode() for i, _, h, _ in rows if i is None and (h or "") not in first or i is not None and first[h or ""] == i)


def test_half_of_all_pages_hold_one_payload(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "the same " * 50 if i % 2 else f"page {i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = warc.archived(pages, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert Counter(x["record_type"] for x in out) == {"response": 201, "revisit": 199} and {x["refers_to"] for x in out} == {None, 1}
    headers = warc.read_headers(spark, str(tmp_path / "a"))
    assert not {"payload", "html"} & set(headers.columns)  # what shuffles by digest holds no payload


def test_record_ids():
    for i in (0, 1, -1, 2**63 - 1, -(2**63), 123456789012345, None):
        assert warc.page_of(warc.record_id(i, b"x")) == i
    assert warc.page_of("<urn:uuid:f81d4fae-7dec-41d0-a765-00a0c91e6bf6>") is None and warc.page_of(None) is None


def test_language_id_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("held", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.filter("NOT held"))
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !!"), (-4, "the " * 9000)], "doc_id long, text string")
    out = {x["doc_id"]: x for x in langid.predict(docs.select("doc_id", "text").unionByName(extra), model).collect()}
    truth = {x["doc_id"]: x["lang"] for x in docs.filter("held").collect()}
    assert sum(out[i]["lang_pred"] == lang for i, lang in truth.items()) >= 0.95 * len(truth)
    assert sum(out[i]["rejected"] for i in truth) <= 0.02 * len(truth)
    for i in (-1, -2, -3):
        assert (out[i]["lang_pred"], out[i]["score"], out[i]["rejected"]) == ("und", 0.0, True)
    assert out[-4]["lang_pred"] in model.languages and all(0 <= x["score"] <= 1 for x in out.values())
    none = langid.predict(extra, langid.fit(docs.limit(0)))
    assert {x["lang_pred"] for x in none.collect()} == {"und"}


def plain_language(model, text):
    """Nearest centroid and its cosine, n-gram by n-gram over dictionaries."""
    clean = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
    clean = re.sub(" +", " ", clean)
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(clean) - n + 1):
            if clean[i : i + n] == " ":
                continue
            h = 0
            for k, c in enumerate(clean[i : i + n], 1):
                h = (h * 0x01000193 + ord(c) + k) % 2**32
            counts[(h * 0x9E3779B1) % 2**32 >> (32 - (model.columns.bit_length() - 1))] += 1
    vector = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in vector.values()))
    cosines = [sum(x * float(c[k]) for k, x in vector.items()) / norm for c in model.centroids]
    best = max(range(len(cosines)), key=lambda i: cosines[i])
    return model.languages[model.owner[best]], min(1.0, max(0.0, cosines[best])), cosines[best] < float(model.least[model.owner[best]])


def test_language_id_against_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, columns=1024)
    texts = [r["text"] for r in docs.limit(40).collect()] + ["ÉÀ ß", "a", "İ x", "x" * 5000, "日本 語"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x for x in langid.predict(rows, model).collect()}
    for i, t in enumerate(texts):
        lang, score, rejected = plain_language(model, t)
        assert (got[i]["lang_pred"], got[i]["rejected"]) == (lang, rejected) and got[i]["score"] == pytest.approx(score, abs=1e-4)
    assert got[len(texts)]["score"] == pytest.approx(got[0]["score"], abs=1e-6)


def test_noise_and_languages_left_out_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL")
    model = langid.fit(docs.filter("lang != 'fr'"))
    r = random.Random(9)
    noise = spark.createDataFrame([(-i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz    ", k=600))) for i in range(1, 60)], "doc_id long, text string")
    out = langid.predict(docs.select("doc_id", "text", "lang").unionByName(noise.withColumn("lang", F.lit("noise"))), model)
    share = {x["lang"]: x["r"] for x in out.groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("r")).collect()}
    assert share["noise"] >= 0.95 and share["fr"] >= 0.9
    assert all(share[x] <= 0.01 for x in model.languages)


def test_languages_that_cannot_be_learned(spark):
    rows = [(i, "uno dos tres", "es") for i in range(6)] + [(10, "x y " * 6000, "long"), (11, "123", "digits"), (12, None, "none"), (None, "solo", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(docs).languages == ["es", "one"] and langid.fit(docs.filter("lang = 'long'")).languages == []
    tie = langid.fit(spark.createDataFrame([(1, "aa bb", "b"), (2, "aa bb", "a")], "doc_id long, text string, lang string"))
    assert langid.predict(docs.limit(1).select(F.lit("aa bb").alias("text")), tie).first()["lang_pred"] == "a"


def test_pseudonyms(spark):
    r = random.Random(5)
    cards = [b + pii.luhn_digit(b) for b in ("".join(r.choices("0123456789", k=15)) for _ in range(50))]
    lines = [f"pay {c} now, {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}; born 1987-02-28, mail jo.x{i}@h.example.com, ip 10.2.3.{i}, +1 (578) 555-{1000 + i}" for i, c in enumerate(cards)]
    clean = ["version 4.0. CC BY-NC 4.0", "4111 1111 1111 1112", "1987-02-30", "300.1.1.1", "000-12-3456", "no digits", "", "1.2.3.4.5"]
    rows = [(i, t, "en", "s") for i, t in enumerate([*lines, *clean, None])]
    docs = frame(spark, rows).select("doc_id", "text", "keep_id")
    out = pii.pseudonymised(docs, b"key")
    got = {x["doc_id"]: x for x in out.collect()}
    seen = {}
    for i, t, *_ in rows:
        x = got[i]
        if i >= len(lines):
            assert x["text"] == t and sum(x[f"n_{k}"] for k in pii.KINDS) == 0
            continue
        assert (x["n_card"], x["n_date"], x["n_email"], x["n_ip"], x["n_phone"]) == (2, 1, 1, 1, 1)
        assert len(x["text"].split()) == len(t.split()) and cards[i] not in x["text"] and f"jo.x{i}@" not in x["text"]
        new = re.search(r"pay (\d{16}) now, ([\d ]{19});", x["text"])
        assert new[2].replace(" ", "") == new[1] and pii.luhn_digit(new[1][:-1]) == new[1][-1]
        seen[new[1]] = i
        assert re.search(r"born \d{4}-\d{2}-\d{2}, ", x["text"])[0] == re.search(r"born \d{4}-\d{2}-\d{2}, ", got[0]["text"])[0]
    assert len(seen) == len(cards)
    back = {x["doc_id"]: x["text"] for x in pii.pseudonymised(out.select("doc_id", "text"), b"key", back=True).collect()}
    assert back == {i: t for i, t, *_ in rows}
    assert pii.pseudonymised(docs.limit(0), b"key").count() == 0


def test_cards_and_ibans_among_other_groups():
    r = random.Random(12)

    def iban(country, n):
        rest = "".join(r.choices("0123456789", k=n - 4))
        return country + pii._iban_check(country, rest) + rest

    by_four = lambda x: " ".join(x[i : i + 4] for i in range(0, len(x), 4))
    for _ in range(300):
        body = "4" + "".join(r.choices("0123456789", k=14))
        card = body + pii.luhn_digit(body)
        number = by_four(iban(*r.choice([("ES", 24), ("PL", 28), ("DE", 22), ("NO", 15), ("CZ", 24)])))
        forms = [f"{c}{tail}" for c in (card, by_four(card), by_four(card).replace(" ", "-")) for tail in (" 12/27", " 123", " 12 27", " 123 AND")]
        forms += [f"no. 12 {by_four(card)}", f"{by_four(card)} 123 {by_four(card)} 12/27", f"on 12 27 123 {by_four(card)} 7"]
        for text in forms:
            new, found = pii.replaced(text, b"key", {})
            assert card not in new.replace(" ", "").replace("-", "") and found["card"] == text.replace(" ", "").replace("-", "").count(card), text
            assert pii.replaced(new, b"key", {}, back=True)[0] == text
        for text in (f"{number} AND more", f"{number} 12", f"{number} 2027", f"IN24 {number} TO", f"{number} {number} 1"):
            new, found = pii.replaced(text, b"key", {})
            assert number not in new and found["iban"] == text.count(number), text
            assert pii.replaced(new, b"key", {}, back=True)[0] == text
    phone = "1234 578-555-1000"
    new, found = pii.replaced(phone, b"key", {})
    assert sum(found.values()) == 1 and pii.replaced(new, b"key", {}, back=True)[0] == phone
    assert pii.replaced("1234 5678 9012 3456 12/27, ES92 2100 0418 4502 0005 1332 AND", b"key", {})[1] == dict.fromkeys(pii.KINDS, 0)


def plain_permuted(value, size, key, tweak):
    """The Feistel network again, on bit strings."""
    bits = len(bin(size - 1)) - 2
    half = (bits + 1) // 2
    width = -(-half // 8)
    while True:
        both = bin(value)[2:].zfill(2 * half)
        left, right = both[:half], both[half:]
        for i in range(pii.ROUNDS):
            data = b"|".join([tweak.encode(), str(size).encode(), str(i).encode(), int(right, 2).to_bytes(width, "big")])
            f = bin(int(hashlib.blake2b(data, digest_size=max(width, 8), key=key).hexdigest(), 16))[2:].zfill(64)[-half:]
            left, right = right, "".join(str(int(a != b)) for a, b in zip(left, f))
        value = int(left + right, 2)
        if value < size:
            return value


def test_against_a_plain_version():
    """Known values between words without digits: only they change, and to what the plain network says."""
    r = random.Random(21)
    key = b"k" * 32
    first = date(1900, 1, 1).toordinal()
    words = ["alpha", "beta,", "gamma;", "(delta)", "der", "éé"]

    def card():
        body = "4" + "".join(r.choices("0123456789", k=14))
        new = f"{plain_permuted(int(body), 10**15, key, 'card16'):015d}"
        return body + pii.luhn_digit(body), new + pii.luhn_digit(new)

    def ip():
        value = r.randrange(1 << 32)
        return tuple(".".join(str(v >> k & 255) for k in (24, 16, 8, 0)) for v in (value, plain_permuted(value, 1 << 32, key, "ip")))

    def ssn():
        ok = lambda v: f"{v:09d}"[:3] not in ("000", "666") and v < 900_000_000 and v // 10_000 % 100 and v % 10_000
        value = next(v for v in iter(lambda: r.randrange(10**9), None) if ok(v))
        new = plain_permuted(value, 10**9, key, "ssn")
        while not ok(new):
            new = plain_permuted(new, 10**9, key, "ssn")
        return tuple(f"{v:09d}"[:3] + "-" + f"{v:09d}"[3:5] + "-" + f"{v:09d}"[5:] for v in (value, new))

    def day():
        old = date.fromordinal(first + r.randrange(73049))
        new = old
        while new is old or (new.day > 12) != (old.day > 12):
            new = date.fromordinal(first + plain_permuted(new.toordinal() - first, 73049, key, "date"))
        form = r.choice(["%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"] if old.day > 12 else ["%Y-%m-%d", "%d.%m.%Y"])
        return tuple(d.strftime(form) for d in (old, new))

    for _ in range(300):
        text, want = [], []
        for _ in range(r.randrange(1, 12)):
            old, new = r.choice([card, ip, ssn, day])() if r.random() < 0.5 else (r.choice(words),) * 2
            text += [old, "and"]
            want += [new, "and"]
        got, _ = pii.replaced(" ".join(text), key, {})
        assert got == " ".join(want)
        assert pii.replaced(got, key, {}, back=True)[0] == " ".join(text)


def test_a_date_in_three_forms_stays_one_date(spark):
    texts = ["2021-05-13", "05/13/2021", "13.05.2021", "2021-05-09", "9.5.2021", "09/05/2021"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(6, texts[0])], "doc_id long, text string")
    for key in (b"k", b"a key of more than sixty-four bytes " * 9):
        out = pii.pseudonymised(docs, key)
        got = {x["doc_id"]: x["text"] for x in out.collect()}
        iso, us, dotted = (date(*time.strptime(got[i], f)[:3]) for i, f in ((0, "%Y-%m-%d"), (1, "%m/%d/%Y"), (2, "%d.%m.%Y")))
        assert iso == us == dotted != date(2021, 5, 13) and got[6] == got[0]
        assert len({date(*time.strptime(got[i], f)[:3]) for i, f in ((3, "%Y-%m-%d"), (4, "%d.%m.%Y"), (5, "%d/%m/%Y"))}) == 1
        back = {x["doc_id"]: x["text"] for x in pii.pseudonymised(out.select("doc_id", "text"), key, back=True).collect()}
        assert {i: t.lstrip("0") for i, t in back.items()} | {4: texts[4]} == {i: t.lstrip("0") for i, t in enumerate([*texts, texts[0]])}


def test_phones_and_secrets():
    k = b"key"
    for text in ("+49 30 12345678", "+44 20 7946 0958", "+33 1 23 45 67 89", "token = aB3+dEf/9hIjKlMn_pq", 'secret="0123456789abcdef"', "password: Xy12-Xy12-Xy12-Xy12"):
        new, found = pii.replaced(text, k, {})
        assert sum(found.values()) == 1 and new != text and len(new) == len(text) and pii.replaced(new, k, {}, back=True)[0] == text
    for text in ("+299 1234567", "+33 01 23 45 67 89", "+33 1 23 45 67", "token = internationalizations", "token = short1"):
        assert pii.replaced(text, k, {}) == (text, dict.fromkeys(pii.KINDS, 0)), text


def test_names_that_clash_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, n_card int")
    with pytest.raises(ValueError):
        pii.pseudonymised(docs, b"k")
    with pytest.raises(ValueError):
        langid.predict(docs.withColumnRenamed("n_card", "score"), langid.Model(64))


def test_feistel_is_a_permutation():
    for size in (1, 2, 10, 37, 1000):
        image = [pii.permuted(v, size, b"k", "t") for v in range(size)]
        assert sorted(image) == list(range(size))
        assert [pii.permuted(v, size, b"k", "t", back=True) for v in image] == list(range(size))


@pytest.mark.parametrize(
    "text,kind",
    [
        ("at 2021-05-13T10:00:00Z", "date"), ('{"password": "hunter2hunter2"}', "secret"), ("Password: hunter2x", "secret"), ("SECRET='aB3dE6gH9jK2mN5p'", "secret"), ("client_secret=ab12cd34ef56", "secret"),
        ("Api-Key: " + "x1Y2" * 60, "secret"), ("token = " + "0123456789abcdef" * 20, "secret"), ("mail jörg.weiß7@example.org", "email"), ('{"api_key" : "Zz9-yy8/xx7+ww6"}', "secret"),
    ],
)
def test_forms_of_personal_data(text, kind):
    new, found = pii.replaced(text, b"key", {})
    assert found == dict.fromkeys(pii.KINDS, 0) | {kind: 1} and new != text and len(new) == len(text)
    assert pii.replaced(new, b"key", {}, back=True)[0] == text


@pytest.mark.parametrize("text", ["the password: is required", "token: transferable", "a secret: something", "Secret: short1", "1 May 2021T", "the tokens = 12345678901 of all", "2021-05-13Tuesday 1"])
def test_forms_that_are_no_personal_data(text):
    assert pii.replaced(text, b"key", {}) == (text, dict.fromkeys(pii.KINDS, 0))
