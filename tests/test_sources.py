"""Chunks, loaders, list files and the knowledge base."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.operators import chunking as C
from kasumi.operators.dictionary import Dictionary, Term
from kasumi.sources import knowledge, lists, loaders


def test_ladders():
    text = "one two three. four five six! " * 20
    parts = C.split(text, C.GENERAL, 60, 0)
    assert all(len(p) <= 60 for p in parts) and "".join(parts).replace(" ", "") == text.replace(" ", "")
    lapped = C.split("abcdefghij" * 5, [""], 10, 3)
    assert all(a[-3:] == b[:3] for a, b in zip(lapped, lapped[1:], strict=False)) and max(map(len, lapped)) <= 10
    assert C.split("", C.GENERAL, 10, 0) == [] and C.split("short", C.GENERAL, 10, 0) == ["short"]
    assert C.settings("docx") == (900, 50) and C.settings("odd") == (1000, 100)


def test_markdown():
    text = "intro\n\n# A\nbody a\n\nmore\n## B\nbody b\n```\n# no heading\n```\n# C\n" + "long. " * 300
    parts = C.split_markdown(text)
    assert parts[0] == "intro\n\n# A\nbody a  \nmore\n\n## B\nbody b\n```\n# no heading\n```"
    assert parts[1].startswith("# C") and all(len(p) <= 800 for p in parts[1:])
    assert C.split_markdown("") == [] and C.split_markdown("# only a heading") == []
    assert C.sections("# A\nx\n# A\ny") == [(["# A"], "x  \ny")]


def test_clean_pdf(spark):
    row = spark.createDataFrame([("a\nb。\nc\n\n\n\nd\n•x\n1.2.  y   z \n",)], "t string").select(C.clean_pdf(F.col("t")).alias("x")).first()
    assert row.x == "a b。\nc\n\n d •x 1.2. y z"  # the last of several line breaks is one that a line's end made
    row = spark.createDataFrame([("。\n•x。\n1.2.  y",)], "t string").select(C.clean_pdf(F.col("t")).alias("x")).first()
    assert row.x == "。\n• x。\n1.2. y"


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "# A\nx", "md"), (2, "y" * 2500, "TXT"), (3, None, None), (4, "z", None)], "doc_id long, text string, file_type string")
    got = sorted((r.doc_id, r.chunk_index, len(r.chunk)) for r in C.chunks(df).collect())
    assert got == [(1, 0, 5), (2, 0, 1000), (2, 1, 1000), (2, 2, 700), (4, 0, 1)]
    sizes = df.select(C.settings_column(F.lower("file_type")).alias("s")).collect()
    assert [tuple(r.s) for r in sizes] == [(800, 0), (1000, 100), (1000, 100), (1000, 100)]


def pack(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://w" xmlns:r="http://r"'
DOCX = pack({
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="r1" Target="http://x"/></Relationships>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="L2"><w:name w:val="List Number 2"/></w:style></w:styles>',
    "word/document.xml": f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p>
<w:p><w:r><w:t>a </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:drawing/></w:r></w:p>
<w:p><w:pPr><w:pStyle w:val="L2"/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:p/>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl>
</w:body></w:document>""",
})
XLSX = pack({
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>a\nb</t></si></sst>",
    "xl/worksheets/s1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"/></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>0.333333333333</v></c></row><row/></sheetData></worksheet>',
})
P = 'xmlns:p="http://p" xmlns:a="http://a" xmlns:r="http://r"'


def shape(x, y, text):
    return f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'


PPTX = pack({
    "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst><p:sldSz cx="1000" cy="1000"/></p:presentation>',
    "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/s1.xml"/></Relationships>',
    "ppt/slides/_rels/s1.xml.rels": '<Relationships><Relationship Id="r1" Target="../notesSlides/n1.xml"/></Relationships>',
    "ppt/notesSlides/n1.xml": f"<p:notes {P}><p:cSld><p:spTree>{shape(0, 0, 'note')}{shape(0, 9000, '1')}</p:spTree></p:cSld></p:notes>",
    "ppt/slides/s1.xml": f"""<p:sld {P}><p:cSld><p:spTree>{shape(500, 100, 'right')}{shape(0, 200, 'left')}<p:grpSp>{shape(0, 90000, 'low')}</p:grpSp><p:pic/>
<p:graphicFrame><a:off x="0" y="99000"/><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x,y</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>z</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame></p:spTree></p:cSld></p:sld>""",
})


def test_office_files():
    assert loaders.parse_docx(DOCX) == [({}, "# Title\n\na **bold**[link](http://x)[画像]\n\n  1. item\n\n|h||\n|---|---|\n|1|2|")]
    assert loaders.parse_xlsx(XLSX) == [({"sheet_name": "S"}, "|name|Col_3|\n|---|---|\n|a b|0.33333333|")]
    assert loaders.parse_pptx(PPTX) == [({"slide_number": "1"}, 'left\n[Image]\nright\nlow\n"x,y",z\nnote')]
    assert loaders.parse_pptx(PPTX, notes="top", combine=True)[0][1].startswith("note\nleft")


def test_encodings_and_markup():
    for name in ("utf-8", "cp932", "euc-jp"):
        assert loaders.decoded("日本語テキスト".encode(name)) == "日本語テキスト"
    assert loaders.decoded(b"\xff\xfe\xfd") and loaders.decoded("é".encode("latin-1"), "latin-1") == "é"
    assert loaders.parse_html(b"<title>T</title><p>a  b<script>x</script><p>c") == [({}, "T\n\na b\n\nc")]
    assert loaders.parse_xml(b"<a> x <b>y</b></a>") == [({}, "x\n\ny")]
    with pytest.raises(ValueError, match="document type"):
        loaders.parse_xml(b'<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>')
    assert loaders.clean_table([["Unnamed: 0", "b\nc", ""], ["", "", ""], ["1", " 2 ", ""]]) == [["Col_1", "b c"], ["1", "2"]]
    assert loaders.clean_table([["a", "b"], ["x", "Unnamed: 1"], ["1", "2"]], 2) == [["a > x", "b"], ["1", "2"]]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ＡＢＣ".encode("cp932"))
    (tmp_path / "b.docx").write_bytes(DOCX)
    (tmp_path / "c.odd").write_bytes(b"zz")
    loaders.register(".odd", lambda raw: [({"n": "1"}, raw.decode()), ({"n": "2"}, "two")], own := dict(loaders.PARSERS))
    got = {(r.file_name, r.page): r for r in loaders.load(spark, str(tmp_path), parsers=own).collect()}
    assert got["a.txt", 0].text == "ABC" and got["a.txt", 0].meta["file_type"] == "txt"
    assert got["c.odd", 1].text == "two" and got["c.odd", 1].meta["n"] == "2"
    chunks = {r.path.rpartition("/")[2]: r.chunks for r in loaders.load_chunks(spark, str(tmp_path), parsers=own).collect()}
    assert chunks["c.odd"] == ["zz", "two"] and chunks["b.docx"][0].startswith("# Title")
    with pytest.raises(Exception, match="no parser for c.odd"):
        loaders.load(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="(?i)path"):
        loaders.load(spark, str(tmp_path / "missing")).collect()


def test_list_files(tmp_path):
    path = str(tmp_path / "d.yaml")
    own = Dictionary([Term("b", V.PERSON), Term(" ", V.PERSON), Term("Ａ", V.TRADEMARK, ("x", " "), "[m]", True), Term("a", V.PERSON), Term("z", "other")])
    lists.save_dictionary(path, own)
    back = lists.load_dictionary(path).terms
    assert back == [Term("Ａ", V.TRADEMARK, ("x",), "[m]", True), Term("a", V.PERSON), Term("b", V.PERSON), Term("z", "other")]
    (tmp_path / "e.yaml").write_text("社員名:\n- 山田\n社名:\n- name: X\n  mask: nan\n", encoding="utf-8")
    assert lists.load_dictionary(str(tmp_path / "e.yaml")).terms == [Term("山田", V.PERSON), Term("X", V.COMPANY)]
    lists.save_allow_entries(path, ["b", ("a", True), "b", " "])
    assert lists.load_allow_entries(path) == [("a", True), ("b", False)]
    assert lists.load_allowlist(path).embed == {"a"} and not lists.load_allowlist(str(tmp_path / "none"))


def test_knowledge_base(spark):
    class Client:
        def list_documents(self):
            return {"items": [{"id": 1, "title": "one"}, {"document_id": "x"}]}

        def get_document(self, i):
            return {"1": {"chunks": [{"text": "a"}, {"page_content": "b"}, " "]}, "x": '{"content": "whole"}'}[i]

    class Broken(Client):
        def get_document(self, i):
            try:
                raise ExceptionGroup("outer", [ValueError("inside")])
            except ExceptionGroup as error:
                raise RuntimeError("x") from error

    got = {r.id: (r.title, r.chunks) for r in knowledge.read(spark, Client).collect()}
    assert got == {"1": ("one", ["a", "b"]), "x": ("", ["whole"])}
    assert knowledge.listed("[1, 2]") == [{"id": "1"}, {"id": "2"}] and knowledge.listed({}) == []
    try:
        Broken().get_document("1")
    except RuntimeError as error:
        assert str(knowledge.root_cause(error)) == "inside"


def test_lengths_in_tokens(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    length = C.TokenLength(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    assert length("hello world") == 2 and length("") == 0
    text = ". ".join("word " * 30 for _ in range(60))
    by_tokens = [r.chunk for r in C.chunks(spark.createDataFrame([(1, text, "txt")], "doc_id long, text string, file_type string"), length=length).collect()]
    assert 1 < len(by_tokens) < len(C.split_by_kind(text, "txt")) and all(length(x) <= 1000 for x in by_tokens)


def workbook(sheet, strings="", styles=""):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as pack:
        pack.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        pack.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        pack.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{sheet}</sheetData></worksheet>")
        pack.writestr("xl/sharedStrings.xml", f"<sst>{strings}</sst>")
        pack.writestr("xl/styles.xml", styles or "<styleSheet/>")
    return raw.getvalue()


def test_typed_cells_and_readings():
    strings = "<si><t>h1</t></si><si><t>h2</t></si><si><r><t>山</t></r><r><t>田</t></r><rPh sb='0' eb='2'><t>ヤマダ</t></rPh></si>"
    styles = "<styleSheet><numFmts><numFmt numFmtId='164' formatCode='yyyy&quot;年&quot;m'/><numFmt numFmtId='165' formatCode='0.0&quot;days&quot;'/></numFmts><cellXfs><xf numFmtId='0'/><xf numFmtId='14'/><xf numFmtId='164'/><xf numFmtId='165'/></cellXfs></styleSheet>"
    rows = "<row><c r='A1' t='s'><v>0</v></c><c r='B1' t='s'><v>1</v></c></row><row><c r='A2' t='s'><v>2</v></c><c r='B2' s='1'><v>45292</v></c></row><row><c r='A3' t='b'><v>1</v></c><c r='B3' s='2'><v>45292.5</v></c></row><row><c r='A4' t='b'><v>0</v></c><c r='B4' s='3'><v>2.5</v></c></row><row><c r='A5' t='inlineStr'><is><t>x</t><rPh><t>y</t></rPh></is></c><c r='B5' t='str'><v>f</v></c></row>"
    table = loaders.parse_xlsx(workbook(rows, strings, styles))[0][1]
    assert [line.strip("|").split("|") for line in table.split("\n")[2:]] == [["山田", "2024-01-01 00:00:00"], ["True", "2024-01-01 12:00:00"], ["False", "2.5"], ["x", "f"]]


def test_unreadable_files_are_rows(spark, tmp_path):
    (tmp_path / "a.txt").write_text("fine")
    (tmp_path / "b.xlsx").write_bytes(b"not a zip")
    (tmp_path / "c.odd").write_text("x")
    rows = {r.file_name: r for r in loaders.load(spark, str(tmp_path), on_error="keep").collect()}
    assert (rows["a.txt"].text, rows["a.txt"].error) == ("fine", None)
    assert rows["b.xlsx"].text is None and "zip" in rows["b.xlsx"].error.lower() and "no parser" in rows["c.odd"].error
    assert [r.chunks for r in loaders.load_chunks(spark, str(tmp_path), on_error="keep").collect()] == [["fine"]]
    with pytest.raises(Exception, match="no parser|zip"):
        loaders.load(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        loaders.load(spark, str(tmp_path), on_error="x")


def test_a_detector_of_encodings_is_asked_last(monkeypatch):
    raw = b"\x81\xff\x00"
    assert "\ufffd" in loaders.decoded(raw)
    monkeypatch.setattr(loaders, "_detected", lambda raw: "latin-1")
    assert loaders.decoded(raw) == raw.decode("latin-1")
