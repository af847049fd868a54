"""The two systems' consensus, anchors, promotion, demotion."""

import pytest
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.functions.text import vote_category
from kasumi.operators import consensus as C


def raw(spark, text, votes):
    """Votes (start, end, channel, label) on one text."""
    rows = [(1, s, e, ch, label, k) for k, (s, e, ch, label) in enumerate(votes)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, channel string, label string, ord long")
    return df.withColumn("category", F.coalesce(vote_category(F.col("channel"), F.col("label")), F.lit(V.OTHER))), spark.createDataFrame([(1, text)], "doc_id long, text string")


def decide(spark, surface, votes):
    r = C.resolve(*raw(spark, surface, [(0, len(surface), *v) for v in votes])).first()
    return r.category, r.confidence


CASES = [
    ("小坂", [("llm", "Person")], (V.PERSON, V.MEDIUM)),
    ("小坂", [("llm", "Person"), ("sudachi", "名詞-固有名詞-人名-姓")], (V.PERSON, V.STRONG)),
    ("小坂", [("sudachi", "名詞-固有名詞-人名-姓"), ("m1", "Person"), ("m2", "PERSON")], (V.PERSON, V.MEDIUM)),
    ("小坂", [("m1", "City"), ("llm", "Person")], (V.PERSON, V.MEDIUM)),
    ("小坂", [("m1", "Company"), ("llm", "Person")], (V.PERSON, V.STRONG)),
    ("小坂", [("m1", "City"), ("llm", "City")], (V.PLACE, V.WEAK)),
    ("FIARSL", [("m1", "Person")], (V.OTHER, V.WEAK)),
    ("IBM", [("m1", "Company"), ("llm", "Company")], (V.COMPANY, V.STRONG)),
    ("Em_Execution", [("m1", "Show_Organization"), ("llm", "Trademark")], (V.TRADEMARK, V.MEDIUM)),
    ("x", [("dict", "社名(辞書)"), ("llm", "Person")], (V.COMPANY, V.SURE)),
    ("小坂", [("session", "人名(確認済)"), ("m1", "Person")], (V.PERSON, V.STRONG)),
    ("小坂", [("llm", "Mystery")], (V.OTHER, V.MEDIUM)),
]


@pytest.mark.parametrize(("surface", "votes", "expected"), CASES)
def test_truth_table(spark, surface, votes, expected):
    assert decide(spark, surface, votes) == expected


def test_anchors_split_a_cluster(spark):
    text = "SONY・Nikon・Canon"
    votes = [(0, 16, "m1", "Company"), (0, 4, "dict", "社名(辞書)"), (5, 10, "m2", "Company"), (11, 16, "dict", "社名(辞書)")]
    got = [(r.start, r.end, r.confidence) for r in C.resolve(*raw(spark, text, votes)).orderBy("start").collect()]
    assert got == [(0, 4, V.SURE), (5, 10, V.MEDIUM), (11, 16, V.SURE)]


def test_touching_spans_stay_apart(spark):
    got = C.resolve(*raw(spark, "abcd", [(0, 2, "llm", "Person"), (2, 4, "llm", "Person")]))
    assert got.count() == 2


def test_promotion_takes_the_first_strong_surface(spark):
    votes = [(0, 2, "m1", "Person"), (0, 2, "llm", "Person"), (3, 5, "m1", "Company"), (3, 5, "llm", "Company"), (6, 11, "m1", "Person"), (6, 11, "llm", "Person")]
    candidates = C.resolve(*raw(spark, "小坂・小坂・小坂 小坂", votes))
    extra = spark.createDataFrame([(1, "大木", V.PERSON), (1, "a b", V.PERSON)], "doc_id long, surface string, category string")
    assert sorted((r.key_text, r.category) for r in C.promotable(candidates, extra).collect()) == [("大木", V.PERSON), ("小坂", V.PERSON)]


def test_demotion(spark):
    def level(surface, votes):
        return C.demote(C.resolve(*raw(spark, surface, [(0, len(surface), *v) for v in votes]))).first().confidence

    assert level("16D", [("llm", "Person")]) == V.FAINT
    assert level("7-410", [("llm", "Employee_ID")]) == V.WEAK
    assert level("IBM", [("llm", "Company")]) == V.MEDIUM
    assert level("FIARSL", [("llm", "Person")]) == V.FAINT
    assert level("東京", [("llm", "City")]) == V.WEAK
    assert level("16D", [("dict", "社名(辞書)")]) == V.SURE


def test_contacts_beat_everything(spark):
    votes, docs = raw(spark, "x@acme.co.jp", [(2, 6, "dict", "社名(辞書)")])
    contacts = spark.createDataFrame([(1, 0, 12, "x@acme.co.jp")], "doc_id long, start int, end int, surface string")
    got = C.with_contacts(C.resolve(votes, docs), contacts).collect()
    assert [(r.start, r.end, r.category, r.confidence) for r in got] == [(0, 12, V.CONTACT, V.STRONG)]


def test_tally_counts_channels(spark):
    votes, _ = raw(spark, "x", [(0, 1, "m1", "Person"), (0, 1, "m1", "PERSON"), (0, 1, "llm", "Person"), (0, 1, "llm", "Mystery")])
    assert [tuple(r) for r in C.tally(votes, ["doc_id"]).collect()] == [(1, V.PERSON, 2)]
