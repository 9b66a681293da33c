"""Where a sentence is put into a document, on hand-made documents."""

import duckdb
import pytest
from pyspark.sql import functions as F

from rankweave.plans import ORACLES, QUERIES, reading
from rankweave.plans.registry import Tables

NAME = "SC22_condition_markers"
#: Texts whose middle lies within a word, so that one of its halves reads as a marker: 16 h, 88.161 h, Spf, 5 days, T84.
CUT = ["Ab 16 h|aben. Zwei", "Es war 88.161 h|och und so. Ja.", "Nein.\nS|Spf erber. Nun", "Id 1234|5 days5x. Ab", "Key q|T84 ab, cd. E", "\U0001f600\U0001f600 16 h|aben \U0001f600. Ab"]
#: Texts without an end of a sentence in their second half, of a few characters, or none.
OPEN = ["Ab. Es 16 h|aben das", "ab 3 h|a", "", None]
#: Texts with a marker of their own around the middle, which stays whole.
OWN = {"It took 24| h. Then it": "24 h", "We gave 7 m|M of it. So": "7 mM", "All 3 DSS| colitis! Ab c": "DSS colitis"}


def middle(text):
    """The text without its bar, with spaces at one end so that the bar was in the middle."""
    if not text:
        return text
    a, b = text.split("|")
    return a + b + " " * (len(a) - len(b)) if len(a) > len(b) else " " * (len(b) - len(a)) + a + b


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cut"))
    # further spaces in front and behind give each text all the sentences, with the same middle
    texts = [" " * i + x + " " * i if x else x for x in map(middle, CUT + OPEN + list(OWN)) for i in range(len(reading.CONDITIONS))]
    rows = [(i, x, "en", "web", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


def test_no_marker_comes_from_a_cut_word(spark, folder):
    n = len(CUT + OPEN) * len(reading.CONDITIONS)
    got = dict(QUERIES[NAME](spark, folder).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = dict(con.sql(ORACLES[NAME]).fetchall())
    assert len(got) == len(want) and {i: got[i] for i in range(n)} == {i: want[i] for i in range(n)}
    assert set(want.values()) == set(reading.MARKED)  # every sentence is used


def test_own_markers_around_the_middle_stay(spark, folder):
    n, m = len(CUT + OPEN) * len(reading.CONDITIONS), len(reading.CONDITIONS)
    got = dict(QUERIES[NAME](spark, folder).collect())
    for i, own in enumerate(OWN.values()):
        assert all(own in got[n + m * i + j].split("|") for j in range(m))


def test_the_whole_document_is_around_the_sentence(spark, folder):
    t = Tables(spark, folder)
    glue, end = f". {reading.APART} ", f" {reading.APART} "
    whole = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("own"))
    for r in reading.planted_between(t, reading.CONDITIONS).join(whole, "doc_id").collect():
        before, after = r["text"].split(glue)[0], r["text"].split(end)[-1]
        assert before + after == r["own"] and len(before) >= len(r["own"]) // 2
