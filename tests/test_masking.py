"""The whole plan."""

import pytest
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.operators import entities
from kasumi.operators.allowlist import Allowlist
from kasumi.operators.dictionary import Dictionary, Term
from kasumi.operators.spans import regex_spans
from kasumi.plans.masking import Masking, chunked, unmasked

TERMS = Dictionary([Term("Acme Robotics", V.COMPANY, ("Acme",)), Term("Widget", V.TRADEMARK, (), "[W]")])


def says(pattern, label):
    return lambda texts: regex_spans(texts, pattern).select("doc_id", "start", "end", F.lit(label).alias("label"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, ["Acme Robotics and john@acme.co.jp. Smith (Acme) saw Smith's Widget.", "| a | b |\n|---|---|\n| Acme | 7-410 |"]), (2, ["nothing"]), (3, []), (4, None)], "doc_id long, chunks array<string>")


def test_levels_and_masks(docs):
    masking = Masking(TERMS, {"m1": says(r"Smith \(", "PERSON")}, says(r"Smith|7-410", "Person"), flatten=True)
    masking.llm = lambda texts: says("Smith", "Person")(texts).union(says("7-410", "Employee_ID")(texts))
    analysis, masked = masking.mask_documents(docs)
    levels = {(r.surface, r.confidence) for r in analysis.candidates.collect()}
    assert {("Acme Robotics", V.SURE), ("john@acme.co.jp", V.STRONG), ("7-410", V.WEAK), ("Widget", V.SURE), ("Acme", V.SURE)} <= levels
    texts = {r.doc_id: r.masked_text for r in masked.texts.collect()}
    assert texts[1].startswith("[社1] and [連絡先1]. ") and "[W]" in texts[1] and "Acme" not in texts[1] and "7-410" in texts[1]
    assert texts[1].endswith("| a | b |\n|---|---|\n| [社1] | 7-410 |")
    assert (texts[2], texts[3], texts[4]) == ("nothing", "", "")


def test_promotion_makes_all_occurrences_strong(docs):
    own = docs.where("doc_id = 1")
    masking = Masking(Dictionary(), {"m1": says("^Acme", "COMPANY")}, says("^Acme", "Company"))
    strong = [r.start for r in masking.analyze(own).candidates.where(F.col("surface") == "Acme").orderBy("start").collect()]
    assert len(strong) == 3
    masking.promote = False
    assert masking.analyze(own).candidates.where(F.col("surface") == "Acme").count() == 1


def test_one_occurrence_or_all(docs):
    masking = Masking(Dictionary(), {}, says("Smith", "Person"))
    analysis = masking.analyze(docs.where("doc_id = 1"))
    one = analysis.candidates.where(F.col("surface") == "Smith").orderBy("start").limit(1)
    assert masking.apply(analysis, one, expand=False).texts.first().masked_text.count("[人物1]") == 1
    everywhere = masking.apply(analysis, one)
    assert everywhere.texts.first().masked_text.count("[人物1]") == 2
    assert everywhere.mapping.first().surfaces == ["Smith"]


def test_numbers_skip_masks_of_their_own(spark):
    rows = [(1, 0, 1, "a", V.COMPANY, V.SURE, []), (1, 2, 3, "Widget", V.COMPANY, V.SURE, []), (1, 4, 5, "b", V.COMPANY, V.SURE, []), (1, 6, 7, "A", V.PERSON, V.MEDIUM, [])]
    spans = entities.ordered(spark.createDataFrame(rows, "doc_id long, start int, end int, surface string, category string, confidence string, votes array<struct<channel:string,label:string>>"))
    got = {r.entity: r.placeholder for r in entities.numbered(spans, TERMS).collect()}
    assert got == {"a": "[社1]", "widget": "[W]", "b": "[社2]"}
    groups = {r.entity: (r.category, r["count"]) for r in entities.groups(spans.drop("ord"), TERMS).collect()}
    assert groups["a"] == (V.COMPANY, 2)


def test_allowlist_and_no_detectors(docs):
    masking = Masking(Dictionary(), allowlist=Allowlist.of(["john@acme.co.jp"]))
    analysis, masked = masking.mask_documents(docs)
    assert [r.confidence for r in analysis.candidates.collect()] == [V.EXCLUDED]
    assert masked.mapping.count() == 0


def test_draft(spark):
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "k int")
    assert sorted(r.k for r in entities.with_draft(ids(1, 2), ids(3), ids(2), ["k"]).collect()) == [1, 3]
    assert sorted(tuple(r) for r in entities.draft_of(ids(1, 3), ids(1, 2), ["k"]).collect()) == [(2, "removed"), (3, "added")]


def test_unmask(spark):
    docs = spark.createDataFrame([(1, "a@b.cd and c@d.ef and a@b.cd")], "doc_id long, text string")
    _, masked = Masking().mask_documents(chunked(docs))
    assert masked.texts.first().masked_text == "[連絡先1] and [連絡先2] and [連絡先1]"
    assert unmasked(masked.texts, masked.mapping).first().text == "a@b.cd and c@d.ef and a@b.cd"


def test_addresses_with_brackets_are_masked_whole(spark):
    rows = chunked(spark.createDataFrame([(1, "mail a}b{c@d.ef (or {x}@y.zz) now")], "doc_id long, text string"))
    assert Masking().mask_documents(rows)[1].texts.first().masked_text == "mail [連絡先1] (or [連絡先2]) now"
