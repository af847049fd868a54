"""Reports."""

from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.plans import reports as R


def test_tokens(spark):
    rows = [("小坂", "名詞-固有名詞-人名-姓", "Person", False), ("東京", "名詞-固有名詞-地名", None, False), ("の", "助詞", "", False), ("xyz", "名詞-普通名詞", None, True)]
    tokens = spark.createDataFrame(rows, "surface string, tag string, entity string, unknown boolean")
    assert {r.surface for r in R.token_report(tokens).collect()} == {"小坂", "東京", "xyz"}
    assert R.token_report(tokens, all_tokens=True).count() == 4
    got = {(r.kind, r.value): r.tokens for r in R.token_summary(tokens).collect()}
    assert got == {("proper", "人名"): 1, ("proper", "地名"): 1, ("entity", "Person"): 1, ("unknown", "unknown"): 1, ("gap", "地名"): 1}


def test_leaks_are_redacted(spark):
    rows = spark.createDataFrame([(1, 0, "xAcme", "Acme", V.COMPANY), (1, 1, "Bobby", "Bob", V.PERSON)], "doc_id long, i int, surface string, canonical string, category string")
    assert [tuple(r) for r in R.leak_report(rows).collect()] == [(V.COMPANY, 1)]
    assert R.leak_report(rows, redacted=False).first().surface == "xAcme"


def test_review_and_detections(spark):
    shape = "doc_id long, start int, end int, surface string, category string, confidence string"
    rows = spark.createDataFrame([(1, 0, 1, "b", V.COMPANY, V.STRONG), (1, 2, 3, "a", V.PERSON, V.SURE), (1, 4, 5, "c", V.OTHER, V.FAINT)], shape)
    docs = spark.createDataFrame([(1, "b a c")], "doc_id long, text string")
    got = R.review(rows, docs=docs).collect()
    assert [(r.surface, r.label, r.mask, r.context) for r in got] == [("a", "1 : 確定", True, "b 《a》 c"), ("b", "2 : 強", True, "《b》 a c")]
    spans = spark.createDataFrame([(1, 0, 3, "Person", "why", "exact", "Bob")], "doc_id long, start int, end int, label string, reason string, how string, surface string")
    missing = spark.createDataFrame([(1, "Person", "ghost"), (2, "Odd", "x")], "doc_id long, label string, missing string")
    stored = R.detections(spans, missing)
    assert [tuple(r) for r in R.detected(stored).collect()] == [(1, 0, 3, "Person", "why", "exact")]
    view = {(r.doc_id, r.label): (r.category, r.texts, r.found, r.missed) for r in R.llm_view(spans, missing).collect()}
    assert view == {(1, "Person"): (V.PERSON, ["Bob"], 1, 1), (2, "Odd"): (V.OTHER, [], 0, 1)}
    assert [r.label for r in R.labels(spans).collect()] == ["Person"] and R.labelled(spans, ["x"]).count() == 0


def test_readable(spark):
    masked = spark.createDataFrame([(1, "<[人物1]>\n[人物10]"), (2, None)], "doc_id long, masked_text string")
    mapping = spark.createDataFrame([(1, "[人物1]"), (1, "[人物10]")], "doc_id long, placeholder string")
    got = {r.doc_id: r.html for r in R.readable(masked, mapping).collect()}
    assert got == {1: "&lt;<mark>[人物1]</mark>&gt;<br><mark>[人物10]</mark>", 2: None}
    row = masked.select(R.document_label(F.lit("t"), F.lit("i")).alias("a"), R.document_label(F.lit(""), F.lit("i")).alias("b"), R.timing_caption(F.lit("m"), F.lit(1.25)).alias("c")).first()
    assert (row.a, row.b, row.c[:3]) == ("t (i)", "i", "m 1")
