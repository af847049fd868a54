"""Recognisers in batches, votes of tags, contact patterns, command line."""

import json
import re

import pytest

from kasumi import cli
from kasumi import values as V
from kasumi.operators import recognise as R
from kasumi.plans.masking import Masking, chunked


def stand_in():
    """A loader: capitalised words are people. It is made here, so that tasks get it by value."""

    def load():
        def analyse(texts):
            for text in texts:
                words = [(m.start(), m.end()) for m in re.finditer(r"\w+|\s+", text)]
                tags = ["名詞-固有名詞-人名-姓" if text[a].isupper() else "名詞-普通名詞-一般" for a, _ in words]
                yield R.Analysed(tuple((a, b, tag, text[a:b] == "zzz") for (a, b), tag in zip(words, tags, strict=True)), tuple((a, b, "Person") for a, b in words if text[a].isupper()))

        return analyse

    return load


def test_batches_have_a_budget():
    texts = ["x" * n for n in (5, 4, 20, 1, 1, 9)]
    assert [[len(t) for t in group] for group in R.budgeted(texts, 10)] == [[5, 4], [20], [1, 1], [9]]
    assert list(R.budgeted([], 10)) == []


def test_offsets_are_those_of_the_whole_text(spark):
    df = spark.createDataFrame([(1, "Ann met\n\nBob zzz"), (2, None), (3, ""), (4, "none")], "doc_id int, text string")
    found = R.analysed(df, stand_in()).collect()
    text = "Ann met\n\nBob zzz"
    own = sorted((r.i, r.start, r.end, r.surface, r.unknown) for r in found if r.doc_id == 1 and r.i is not None)
    assert own == [(0, 0, 3, "Ann", False), (1, 4, 7, "met", False), (2, 9, 12, "Bob", False), (3, 13, 16, "zzz", True)]
    assert all(text[s:e] == x for _, s, e, x, _ in own)
    assert sorted((r.start, r.end, r.surface) for r in found if r.label) == [(0, 3, "Ann"), (9, 12, "Bob")]
    assert {r.doc_id for r in found} == {1, 4}
    tokens = {r.surface: r.entity for r in R.labelled_tokens(R.analysed(df, stand_in())).collect()}
    assert tokens == {"Ann": "Person", "met": None, "Bob": "Person", "zzz": None, "none": None}


def test_long_paragraphs_are_cut_for_the_model_only(spark):
    text = "Ann\n" * 30 + "é" * 50 + " Bob"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    plain = stand_in()

    def load():
        inner = plain()

        def analyse(texts):
            assert all(len(x.encode()) <= 40 for x in texts)
            return inner(texts)

        return analyse

    found = R.tokens_of(R.analysed(df, load, longest=40)).orderBy("i").collect()
    assert [r.i for r in found] == list(range(len(found)))
    assert all(text[r.start : r.end] == r.surface for r in found)
    assert [r.start for r in found if r.surface == "Ann"] == list(range(0, 120, 4)) and found[-1].surface == "Bob"


def test_tags_vote(spark):
    df = chunked(spark.createDataFrame([(1, "then Ann came")], "doc_id long, text string"))
    load = stand_in()
    only = Masking(tagger=load).analyze(df).candidates.collect()
    assert [(r.surface, r.category, r.confidence, r.votes[0].channel) for r in only] == [("Ann", V.PERSON, V.MEDIUM, V.POS)]
    both = Masking(detectors={"model": lambda texts: R.entities_of(R.analysed(texts, load))}, tagger=load).analyze(df).candidates.collect()
    assert [(r.surface, r.category) for r in both] == [("Ann", V.PERSON)] and {v.channel for v in both[0].votes} == {V.POS, "model"}


def test_contact_patterns(spark):
    df = chunked(spark.createDataFrame([(1, "call +49 30 123456 or a@b.org")], "doc_id long, text string"))
    masking = Masking(contacts=((V.EMAIL, "@"), (r"\+[0-9 ]{8,}[0-9]", "+")))
    assert sorted(r.surface for r in masking.analyze(df).candidates.collect()) == ["+49 30 123456", "a@b.org"]
    assert Masking(contacts=()).analyze(df).candidates.count() == 0


def test_commands_with_a_recogniser(spark, capsys, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "named", lambda name: stand_in() if name else None)
    assert cli.main(["ner", "--text", "then Ann met Bob", "--recogniser", "m:load", "--labels", "Person"], spark) == 0
    shown = capsys.readouterr().out
    assert "Ann\tPerson\t5\t8" in shown and "<mark" in shown
    assert cli.main(["debug", "--text", "then Ann zzz", "--recogniser", "m:load"], spark) == 0
    shown = capsys.readouterr().out
    assert "Ann" in shown and "then" not in shown and "unknown" in shown
    assert cli.main(["ner", "--text", "then Ann", "--recogniser", "m:load", "--out", str(tmp_path), "--format", "text"], spark) == 0
    assert "Ann</mark>" in next((tmp_path / "pages" / "doc_id=text").glob("part-*")).read_text().replace(" <small>Person</small>", "")
    assert any("Ann\tPerson" in p.read_text() for p in (tmp_path / "entities").glob("part-*"))
    assert cli.main(["mask", "--text", "then Ann and a@b.org", "--recogniser", "m:load"], spark) == 0
    assert "[連絡先1]" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["ner", "--text", "x"], spark)


def test_loaders_by_name():
    assert cli.named("json:loads") is json.loads and cli.named(None) is None
