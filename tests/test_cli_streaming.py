"""The command line and streams."""

import datetime

from kasumi import cli
from kasumi.operators.dictionary import Dictionary, Term
from kasumi.plans.masking import Masking
from kasumi.streaming import masks


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "d.yaml").write_text("社名:\n- Smith\n", encoding="utf-8")
    assert cli.main(["mask", "--dict", str(tmp_path / "d.yaml")], spark) == 0
    shown = capsys.readouterr().out
    assert "[連絡先1]" in shown and "| [社1] | [連絡先3] |" in shown
    cli.main(["audit", "--text", "Smithers and Smith, a@b.cd", "--dict", str(tmp_path / "d.yaml"), "--surfaces"], spark)
    shown = capsys.readouterr().out
    assert "Smithers" in shown.split("# leaks")[1] and "a@b.cd" in shown
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f.txt").write_text("to a@b.cd")
    cli.main(["candidates", str(tmp_path / "in"), "--out", str(tmp_path / "out")], spark)
    assert spark.read.parquet(str(tmp_path / "out" / "candidates")).first().surface == "a@b.cd"


def test_streams(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1, 12)
    shape = "doc_id long, text string, ts timestamp"
    rows = [(1, "mail a@b.cd", at), (2, "none", at + datetime.timedelta(minutes=1)), (3, None, at + datetime.timedelta(minutes=15))]
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    query = masks.masked(stream, Masking(Dictionary([Term("none", "社名")])), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
    query.awaitTermination(120)
    got = {r.doc_id: r.masked_text for r in spark.read.parquet(str(tmp_path / "out" / "texts")).collect()}
    assert got == {1: "mail [連絡先1]", 2: "[社1]", 3: ""}
    counted = masks.contact_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert sorted((r.documents, r.contacts) for r in spark.sql("select * from counted").collect()) == [(1, 0), (2, 1)]
