"""Dictionary and allowlist."""

import random

import pytest
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.operators import allowlist as A
from kasumi.operators import dictionary as D

TERMS = D.Dictionary([D.Term("a b", V.COMPANY, ("ab c",)), D.Term("b", V.PERSON), D.Term("c d a", V.TRADEMARK), D.Term("CB", V.COMPANY, (), "[CB]", True), D.Term("Smash", V.TRADEMARK, (), "", True)])


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_of_matching_equal_the_scan(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcdx") for _ in range(rng.randint(0, 25))) for _ in range(60)]
    keys = {k: (t.canonical, t.category) for k, t in TERMS.keys().items()}
    expected = set()
    for k, text in enumerate(texts):
        units = text.split()
        i = 0
        while i < len(units):
            n = next((n for n in range(min(12, len(units) - i), 0, -1) if "".join(units[i : i + n]) in keys), 0)
            if n:
                expected.add((k, 2 * i, 2 * (i + n) - 1, *keys["".join(units[i : i + n])]))
            i += n or 1
    cut = D.tokenized(docs(spark, texts))
    assert {tuple(r) for r in D.match(cut, TERMS).collect()} == expected
    assert {tuple(r) for r in D.match(cut, TERMS, broadcast_terms=0).collect()} == expected


def test_embedded_terms_stop_at_borders(spark):
    cut = D.tokenized(docs(spark, ["SmashMark CBMark ECBType CB", "xCB", ""]))
    got = sorted((r.doc_id, r.start, r.end, r.canonical) for r in D.match_embedded(cut, TERMS).collect())
    assert got == [(0, 0, 5, "Smash"), (0, 10, 12, "CB"), (1, 1, 3, "CB")]


def test_leaks_are_tokens_that_hold_a_term(spark):
    rows = D.tokens(D.tokenized(docs(spark, ["ECBType CB xcbx cab"])))
    assert sorted((r.surface, r.canonical) for r in D.leaks(rows, TERMS).collect()) == [("ECBType", "CB"), ("cab", "a b"), ("xcbx", "CB")]


def test_own_terms_of_a_document(spark):
    cut = D.tokenized(docs(spark, ["Tanaka met Tanaka", "Tanaka"]))
    terms = spark.createDataFrame([(0, "tanaka", V.PERSON)], "doc_id long, key_text string, category string")
    assert sorted((r.doc_id, r.start, r.end) for r in D.match_by_document(cut, terms).collect()) == [(0, 0, 6), (0, 11, 17)]


def candidates(spark, surfaces, channel="llm"):
    rows = [(0, k, k + len(s), s, V.OTHER, V.WEAK, [(channel, "x")]) for k, s in enumerate(surfaces)]
    return spark.createDataFrame(rows, "doc_id long, start int, end int, surface string, category string, confidence string, votes array<struct<channel:string,label:string>>")


def test_allowlist(spark):
    listed = A.Allowlist.of(["Foo  Bar", ("FB", True), " "])
    got = A.exclude(candidates(spark, ["foo bar", "GetFBData", "FBI", "other"]), listed).orderBy("start").collect()
    assert [r.confidence for r in got] == [V.EXCLUDED, V.EXCLUDED, V.WEAK, V.WEAK]
    assert A.exclude(candidates(spark, ["foo bar"], V.DICT), listed).first().confidence == V.WEAK
    assert A.exclude(candidates(spark, ["x"]), A.Allowlist()).first().confidence == V.WEAK


def test_allowlist_at_token_borders(spark):
    one = candidates(spark, ["用補正値"])
    tokens = spark.createDataFrame([(0, 0, 0, 1, "用"), (0, 1, 1, 3, "補正"), (0, 2, 3, 4, "値")], "doc_id long, i int, start int, end int, surface string")
    assert A.exclude(one, A.Allowlist.of([("補正", True)]), tokens).first().confidence == V.EXCLUDED
    assert A.exclude(one, A.Allowlist.of([("補", True)]), tokens).first().confidence == V.WEAK
    assert A.exclude(one, A.Allowlist.of([("補正", True)])).first().confidence == V.WEAK


def test_space_makes_no_token(spark):
    cut = D.tokenized(docs(spark, ["a b"]), cut=lambda text: ([0, 1, 2], [1, 2, 3]) if text else ([], []))
    assert [r.surface for r in D.tokens(cut).orderBy("i").collect()] == ["a", "b"]
    assert D.tokens(cut).where(F.col("surface") == " ").count() == 0
