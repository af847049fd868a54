"""Files to pages of text: Spark reads the bytes, a parser by file type runs in the tasks.

Text, HTML, XML, Markdown, Word, Excel and PowerPoint files need the standard
library only. PDF needs an optional library, and so do old binary Excel files;
without it such files raise when they are read. ``register`` adds other types.
"""

from __future__ import annotations

import csv
import io
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A parser takes a file's bytes and gives (page's metadata, text) for each page.
Parser = Callable[[bytes], list[tuple[dict[str, str], str]]]
# Fixed: encodings in the order they are tried.
ENCODINGS = ("utf-8", "cp932", "euc-jp", "utf-16")


def decoded(raw: bytes, encoding: str | None = None) -> str:
    """The text in the first encoding that fits, then in the one that a detector names if its library is there; at last UTF-8 with replacement characters."""
    for name in (*((encoding,) if encoding else ()), *ENCODINGS, None):
        try:
            return raw.decode(name or _detected(raw))
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("utf-8", "replace")


def _detected(raw: bytes) -> str:
    try:
        import chardet  # optional
    except ImportError:
        return "none"
    return chardet.detect(raw)["encoding"] or "none"


def parse_text(raw: bytes) -> list[tuple[dict[str, str], str]]:
    return [({}, decoded(raw))]


class _Text(HTMLParser):
    """Texts of elements, without scripts and styles."""

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag, attrs):
        self.skipped += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skipped -= tag in ("script", "style") and self.skipped > 0

    def handle_data(self, data):
        if not self.skipped and data.strip():
            self.parts.append(" ".join(data.split()))


def parse_html(raw: bytes) -> list[tuple[dict[str, str], str]]:
    parser = _Text()
    parser.feed(decoded(raw))
    parser.close()
    return [({}, "\n\n".join(parser.parts))]


def _safe_xml(raw: bytes) -> ElementTree.Element:
    if re.search(rb"<!(DOCTYPE|ENTITY)", raw[:100_000], re.I):
        raise ValueError("XML with a document type is not read")
    return ElementTree.fromstring(raw)


def parse_xml(raw: bytes) -> list[tuple[dict[str, str], str]]:
    return [({}, "\n\n".join(" ".join(x.split()) for x in _safe_xml(raw).itertext() if x.strip()))]


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [x for x in node if _local(x) == name]


def _attribute(node: ElementTree.Element, name: str) -> str:
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), "")


def _relations(pack: zipfile.ZipFile, path: str) -> dict[str, str]:
    folder, _, name = path.rpartition("/")
    try:
        root = _safe_xml(pack.read(f"{folder}/_rels/{name}.rels"))
    except KeyError:
        return {}
    return {x.get("Id", ""): x.get("Target", "") for x in root}


# --- tables --------------------------------------------------------------------------------------


def clean_table(rows: list[list[str]], header_rows: int = 1) -> list[list[str]]:
    """The header first: unnamed columns by number, several header rows joined, cells on one line, empty rows and then columns out."""
    width = max(map(len, rows), default=0)
    grid = [[" ".join(c.split("\n")).strip() for c in r] + [""] * (width - len(r)) for r in rows]
    heads, body = grid[:header_rows], [r for r in grid[header_rows:] if any(r)]
    names = [" > ".join(p for p in (h[k] for h in heads) if p and not p.startswith("Unnamed:")) or f"Col_{k + 1}" for k in range(width)]
    kept = [k for k in range(width) if any(r[k] for r in body)]
    return [[names[k] for k in kept], *([r[k] for k in kept] for r in body)] if kept else []


def markdown_table(rows: list[list[str]]) -> str:
    """Rows with pipes, nothing padded; a rule under the first."""
    if not rows:
        return ""
    line = lambda r: "|" + "|".join(c.replace("|", "\\|") for c in r) + "|"
    return "\n".join([line(rows[0]), "|" + "|".join("---" for _ in rows[0]) + "|", *map(line, rows[1:])])


def number(text: str) -> str:
    """A number in at most eight significant digits."""
    try:
        return f"{float(text):.8g}"
    except ValueError:
        return text


# --- office files ---------------------------------------------------------------------------------


# Fixed: number formats of the file format that show dates or times, and the days that are counted from.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
EPOCH, EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)


def _date_styles(pack: zipfile.ZipFile) -> dict[int, datetime]:
    """Cell styles that show a number as a date, with the day that it counts from."""
    if "xl/styles.xml" not in pack.namelist():
        return {}
    root = _safe_xml(pack.read("xl/styles.xml"))
    own = {int(x.get("numFmtId", 0)): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")) for x in root.iter() if _local(x) == "numFmt"}
    dated = DATE_FORMATS | {k for k, code in own.items() if re.search("[ymdhs]", code, re.I) and not re.search("general", code, re.I)}
    styles = next((x for x in root if _local(x) == "cellXfs"), ())
    return {k: EPOCH for k, x in enumerate(styles) if int(x.get("numFmtId", 0)) in dated}


def _string(item: ElementTree.Element) -> str:
    """A rich text without its phonetic runs."""
    return "".join((x.text or "") if _local(x) == "t" else "".join(t.text or "" for t in _children(x, "t")) if _local(x) == "r" else "" for x in item)


def _cell(cell: ElementTree.Element, shared: list[str], dates: dict[int, datetime]) -> str:
    """A cell's text: numbers in eight digits, dates in ISO form, truth values by name."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_string(x) for x in _children(cell, "is"))
    value = "".join(v.text or "" for v in _children(cell, "v"))
    if kind == "s" and value:
        return shared[int(value)]
    if kind == "b":
        return {"1": "True", "0": "False"}.get(value, value)
    if kind == "n" and value and (epoch := dates.get(int(cell.get("s", -1)))):
        try:
            return str((epoch + timedelta(seconds=round(float(value) * 86_400))))
        except (ValueError, OverflowError):
            return value
    return number(value) if kind == "n" else value


def parse_xlsx(raw: bytes) -> list[tuple[dict[str, str], str]]:
    """A page for each sheet, as a Markdown table."""
    pages = []
    with zipfile.ZipFile(io.BytesIO(raw)) as pack:
        shared = []
        if "xl/sharedStrings.xml" in pack.namelist():
            for item in _safe_xml(pack.read("xl/sharedStrings.xml")):
                shared.append(_string(item))
        dates = _date_styles(pack)
        targets = _relations(pack, "xl/workbook.xml")
        book = _safe_xml(pack.read("xl/workbook.xml"))
        if any(_local(x) == "workbookPr" and x.get("date1904") in ("1", "true") for x in book.iter()):
            dates = {k: EPOCH_1904 for k in dates}
        for sheet in (x for x in book.iter() if _local(x) == "sheet"):
            target = targets[_attribute(sheet, "id")].lstrip("/")
            root = _safe_xml(pack.read(target if target.startswith("xl/") else f"xl/{target}"))
            rows: list[list[str]] = []
            for row in (x for x in root.iter() if _local(x) == "row"):  # a reading aid beside a text isn't part of it
                cells: list[str] = []
                for cell in _children(row, "c"):
                    letters = re.match("[A-Z]*", cell.get("r", ""))[0]
                    column = 0
                    for c in letters:
                        column = column * 26 + ord(c) - 64
                    cells += [""] * (max(column, len(cells) + 1) - len(cells))
                    cells[(column or len(cells)) - 1] = _cell(cell, shared, dates)
                rows.append(cells)
            if table := markdown_table(clean_table(rows)):
                pages.append(({"sheet_name": sheet.get("name", "")}, table))
    return pages


def _run_text(run: ElementTree.Element) -> str:
    text = ""
    for x in run.iter():
        name = _local(x)
        text += (x.text or "") if name == "t" else "\t" if name == "tab" else "\n" if name in ("br", "cr") else "[画像]" if name == "drawing" else ""
    style = {_local(x): x for p in _children(run, "rPr") for x in p}
    on = lambda k: k in style and _attribute(style[k], "val") not in ("0", "false")
    body = text.strip()
    if body and body != "[画像]":
        marks = "**" * on("b") + "*" * on("i")
        if marks:
            return text.replace(body, f"{marks}{body}{marks[::-1]}")
    return text


def _paragraph(p: ElementTree.Element, links: dict[str, str], styles: dict[str, str]) -> str:
    parts = []
    for x in p:
        if _local(x) == "r":
            parts.append(_run_text(x))
        elif _local(x) == "hyperlink":
            text = "".join(_run_text(r) for r in x if _local(r) == "r")
            url = links.get(_attribute(x, "id"), "")
            parts.append(f"[{text}]({url})" if url else text)
    text = "".join(parts).strip()
    if not text:
        return ""
    style = next((_attribute(s, "val") for pr in _children(p, "pPr") for s in _children(pr, "pStyle")), "")
    name = styles.get(style, style)
    if heading := re.fullmatch(r"[Hh]eading ?([1-9])", name):
        return f"{'#' * int(heading[1])} {text}"
    if name.lower() in ("title", "subtitle"):
        return f"{'#' if name.lower() == 'title' else '##'} {text}"
    if name.lower().startswith("list"):
        indent = "  " * ((2 if "3" in name else 1 if "2" in name else 0))
        return f"{indent}{'1.' if 'number' in name.lower() else '-'} {text}"
    return text


def parse_docx(raw: bytes) -> list[tuple[dict[str, str], str]]:
    """One page of Markdown, in the order of the body."""
    with zipfile.ZipFile(io.BytesIO(raw)) as pack:
        links = _relations(pack, "word/document.xml")
        styles = {}
        if "word/styles.xml" in pack.namelist():
            for s in _safe_xml(pack.read("word/styles.xml")).iter():
                if _local(s) == "style":
                    styles[_attribute(s, "styleId")] = next((_attribute(n, "val") for n in _children(s, "name")), "")
        root = _safe_xml(pack.read("word/document.xml"))
    parts = []
    for block in next(x for x in root if _local(x) == "body"):
        if _local(block) == "p":
            parts.append(_paragraph(block, links, styles))
        elif _local(block) == "tbl":
            rows = [[" ".join(filter(None, (_paragraph(p, links, {}) for p in c.iter() if _local(p) == "p"))) for c in _children(r, "tc")] for r in _children(block, "tr")]
            parts.append(markdown_table([r + [""] * (max(map(len, rows)) - len(r)) for r in rows]))
    return [({}, "\n\n".join(p for p in parts if p))]


def _shapes(node: ElementTree.Element, width: int) -> list[tuple[tuple[int, float], str]]:
    """((row, left), text) of a slide's shapes; groups are entered."""
    found = []
    for x in node:
        name = _local(x)
        if name == "grpSp":
            found += _shapes(x, width)
        if name not in ("sp", "pic", "graphicFrame"):
            continue
        off = next((o for o in x.iter() if _local(o) == "off"), None)
        top, left = (int(off.get("y", 0)), int(off.get("x", 0))) if off is not None else (0, 0)
        table = next((t for t in x.iter() if _local(t) == "tbl"), None)
        lines = lambda n: ["".join(t.text or "" for t in p.iter() if _local(t) == "t") for p in n.iter() if _local(p) == "p"]
        if name == "pic":
            text = "[Image]"
        elif table is not None:
            out = io.StringIO()
            csv.writer(out, lineterminator="\n").writerows([" ".join(lines(c)).strip() for c in _children(r, "tc")] for r in _children(table, "tr"))
            text = out.getvalue().strip()
        else:
            text = "\n".join(lines(x)).strip()
        if text:
            found.append(((round(top / 8000), left / width), text))
    return found


def parse_pptx(raw: bytes, notes: str = "bottom", combine: bool = False) -> list[tuple[dict[str, str], str]]:
    """A page for each slide (or one for all), shapes by row and then from the left, notes above or below."""
    pages = []
    with zipfile.ZipFile(io.BytesIO(raw)) as pack:
        deck = _safe_xml(pack.read("ppt/presentation.xml"))
        size = next((x for x in deck.iter() if _local(x) == "sldSz"), None)
        width = int(size.get("cx", 9144000)) if size is not None else 9144000
        targets = _relations(pack, "ppt/presentation.xml")
        for k, slide in enumerate((x for x in deck.iter() if _local(x) == "sldId"), 1):
            path = "ppt/" + targets[next(v for key, v in slide.attrib.items() if key.startswith("{"))].removeprefix("/ppt/")
            tree = next(x for x in _safe_xml(pack.read(path)).iter() if _local(x) == "spTree")
            parts = [text for _, text in sorted(_shapes(tree, width), key=lambda s: s[0])]
            for target in _relations(pack, path).values():
                if "notesSlide" in target:
                    page = _safe_xml(pack.read("ppt/" + target.removeprefix("../").removeprefix("/ppt/")))
                    spoken = [text for _, text in _shapes(next(x for x in page.iter() if _local(x) == "spTree"), width) if not text.isdigit() and text != "[Image]"]
                    parts = [*spoken, *parts] if notes == "top" else [*parts, *spoken]
            if parts:
                pages.append(({"slide_number": str(k)}, "\n".join(parts)))
    return [({}, "\n\n".join(text for _, text in pages))] if combine and pages else pages


def parse_pdf(raw: bytes) -> list[tuple[dict[str, str], str]]:
    """A page for each page with text, numbered from 0."""
    from pdfminer.high_level import extract_pages  # optional
    from pdfminer.layout import LTTextContainer

    pages = []
    for k, page in enumerate(extract_pages(io.BytesIO(raw))):
        if text := "".join(x.get_text() for x in page if isinstance(x, LTTextContainer)).strip():
            pages.append(({"page": str(k)}, text))
    return pages


def parse_xls(raw: bytes) -> list[tuple[dict[str, str], str]]:
    import pandas as pd  # with an optional reader

    sheets = pd.read_excel(io.BytesIO(raw), sheet_name=None, header=None, dtype=str)
    tables = ((name, markdown_table(clean_table(frame.fillna("").values.tolist()))) for name, frame in sheets.items())
    return [({"sheet_name": str(name)}, table) for name, table in tables if table]


PARSERS: dict[str, Parser] = {"txt": parse_text, "md": parse_text, "pdf": parse_pdf, "xlsx": parse_xlsx, "xlsm": parse_xlsx, "xls": parse_xls, "pptx": parse_pptx, "docx": parse_docx, "html": parse_html, "xml": parse_xml}


def register(extension: str, parser: Parser, parsers: dict[str, Parser] | None = None) -> None:
    """Files with this extension go to this parser from now on."""
    (PARSERS if parsers is None else parsers)[extension.lower().lstrip(".")] = parser


PAGES = pa.schema([("path", pa.string()), ("file_name", pa.string()), ("file_type", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("error", pa.string())])


def load(spark: SparkSession, paths: str | list[str], *, parsers: dict[str, Parser] | None = None, on_error: str = "raise") -> DataFrame:
    """(path, file_name, file_type, page, text, meta): a row per page, NFKC-normalised.

    Missing paths raise. A file that has no parser or can't be read raises too, or with ``on_error="keep"`` is
    a row without a page or text whose additional column ``error`` says why, so that one file doesn't end the job.
    """
    if on_error not in ("raise", "keep"):
        raise ValueError(f"on_error is {on_error!r}")
    known = dict(PARSERS if parsers is None else parsers)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "content")

    def pages(path: str, name: str, kind: str, content: bytes) -> Iterator[tuple]:
        if kind not in known:
            raise ValueError(f"no parser for {name}")
        for k, (meta, text) in enumerate(known[kind](content)):
            yield path, name, kind, k, unicodedata.normalize("NFKC", text), sorted({"file_path": path, "file_name": name, "file_type": kind, **meta}.items()), None

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = path.rpartition("/")[2]
                kind = name.rpartition(".")[2].lower() if "." in name else ""
                try:
                    rows = list(pages(path, name, kind, content.as_py()))
                except Exception as error:
                    if on_error == "raise":
                        raise
                    rows = [(path, name, kind, None, None, None, f"{type(error).__name__}: {error}"[:500])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(PAGES)], schema=PAGES)

    found = files.mapInArrow(parsed, "path string, file_name string, file_type string, page int, text string, meta map<string,string>, error string")
    return found.drop("error") if on_error == "raise" else found


def load_chunks(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """(path, chunks): every file's chunks in order of its pages."""
    from kasumi.operators.chunking import chunks

    pages = load(spark, paths, **options).where("text is not null")
    own = pages.select(F.struct("path", "page").alias("at"), "text", "file_type").withColumn("key", F.to_json("at"))
    cut = chunks(own.select("key", "text", "file_type"), key="key")
    named = cut.select(F.get_json_object("key", "$.path").alias("path"), F.get_json_object("key", "$.page").cast("int").alias("page"), "chunk_index", "chunk")
    return named.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "chunk_index", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
