"""Scalar functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.functions import text as T


def column(spark, values, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, s string")
    return [r.x for r in rows.select("k", expression(F.col("s")).alias("x")).orderBy("k").collect()]


def test_code_like_surfaces(spark):
    code = ["16D", "Em_Foo", "a=b", "7-410", "N", "AP・", "theta・「", "会社「A」", "AP-", "-C02", "田中・", "LSMonito(", ")Monitor", "a|b", "C:\\x", "a::b", ""]
    names = ["IBM", "Sony", "Smith", "Sony (Japan)", "会社（日本）", "ジョン・スミス", "C型補正値リミット・チェック結果", "Coca-Cola", "サーバー", "林"]
    assert column(spark, code, T.looks_like_code) == [True] * len(code)
    assert column(spark, names, T.looks_like_code) == [False] * len(names)
    assert column(spark, [None], T.looks_like_code) == [None]


def test_latin_names_and_capitals(spark):
    assert column(spark, ["John Smith", "Anne-Marie", "小坂", "12", "theta", "EndTime", "FIARSL", "Wafer ID"], T.nonperson_latin) == [False] * 4 + [True] * 4
    assert column(spark, ["FIARSL", "WEXPC-YCD", "Ibm", "小X", "12"], T.jargon_caps) == [True, True, False, False, False]


def test_normalize_is_nfkc_casefold_without_space(spark):
    values = ["Tokyo Electron", "ＡＢＣ　ｄ", "Straße", "a\u3000b\tc", "", None, "İ"]
    assert column(spark, values, T.normalize) == [None if v is None else T.normal(v) for v in values]


def test_votes_name_categories(spark):
    rows = spark.createDataFrame([("dict", "社名(辞書)"), ("session", "人名(確認済)"), ("regex", "連絡先"), ("llm", "Person"), ("llm", "person"), ("sudachi", "名詞-固有名詞-人名-姓"), ("ginza", "person"), ("ginza", "N_Person")], "c string, l string")
    got = [r.x for r in rows.select(T.vote_category(F.col("c"), F.col("l")).alias("x")).collect()]
    assert got == [V.COMPANY, V.PERSON, V.CONTACT, V.PERSON, None, V.PERSON, V.PERSON, None]
    ranks = column(spark, [*V.CATEGORIES, "x"], T.category_rank)
    assert ranks == [0, 1, 2, 3, 4, 5, 99]
    assert column(spark, ["確定", "除外", "x"], T.confidence_rank) == [4, -1, 0]


def test_subwords_context_and_hash(spark):
    assert column(spark, ["SmashMark", "ECBType", "HTTPServer2", "FBI", "get_fb"], T.identifier_subwords) == [["Smash", "Mark"], ["ECB", "Type"], ["HTTP", "Server", "2"], ["FBI"], ["get", "fb"]]
    text = "x" * 30 + "NAME" + "y" * 30
    row = spark.createDataFrame([(text, 30, 34), ("ab", 0, 1)], "t string, s int, e int").select(T.context(F.col("t"), F.col("s"), F.col("e")).alias("c")).collect()
    assert [r.c for r in row] == ["…" + "x" * 20 + "《NAME》" + "y" * 20 + "…", "《a》b"]
    chunks = [["a", "bé"], [], [""]]
    got = [r.h for r in spark.createDataFrame([(c,) for c in chunks], "c array<string>").select(T.content_hash(F.col("c")).alias("h")).collect()]
    assert got == [hashlib.sha256(b"".join(x.encode() + b"\0" for x in c)).hexdigest() for c in chunks]


@pytest.mark.parametrize(("tag", "kind"), [("名詞-固有名詞-人名-姓", "人名"), ("名詞-固有名詞", "一般"), ("名詞-普通名詞", None)])
def test_proper_subtype(spark, tag, kind):
    assert column(spark, [tag], T.proper_subtype) == [kind]
