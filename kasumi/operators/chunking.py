"""Splitting documents into chunks, by type of file.

Splitting goes by a ladder of separators: a text is cut at the first separator it
has, short parts are joined up to the chunk size (with an overlap), long ones are
cut again by the rest of the ladder. Markdown is cut at headings first.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kasumi import values as V

Length = Callable[[str], int]
# Fixed: separators by type of file, the coarsest first.
SENTENCES = [r"(?<=[。！？])", r"\. ", "! ", r"\? ", " ", ""]
GENERAL = ["\n\n", "\n", *SENTENCES]
PDF = ["\n\n\n", "\n\n", *SENTENCES]
SHEET = ["\n", "\n\n", r"\|", "(?<=[。！？、])", " ", ""]
SECTION = [r"\n+(?=\|[^\n]+\|[^\n]*\n\|[-:\s|]+\|)", r"\n+(?=<table[^>]*>)", r"\n+\s*(?=\d+(?:\.\d+)*\.\s*[^#\n]+)", r"\n\n+", "\n", "(?<=[。！？])", r"\.\s", r"!\s", r"\?\s", r"\s+"]
LADDERS = {"pdf": PDF, "xlsx": SHEET, "xls": SHEET, "xlsm": SHEET}
MARKDOWN = ("md", "docx")
HEADING = re.compile(r"(#{1,9})(?: (.*))?")


@functools.cache
def _encoding(ranks_path: str, pattern: str):
    import base64
    from pathlib import Path

    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(ranks_path).read_bytes().splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class TokenLength:
    """A length for splitters: the number of tokens by a byte-level vocabulary's file of ranks, loaded once in each process."""

    ranks_path: str
    pattern: str

    def __call__(self, text: str) -> int:
        return len(_encoding(self.ranks_path, self.pattern).encode_ordinary(text))


def settings(kind: str) -> tuple[int, int]:
    """(chunk size, overlap) of a type of file."""
    return V.CHUNKING.get(kind, V.CHUNKING["default"])


def settings_column(kind: Column) -> Column:
    """STRUCT<size, overlap> of a column of types."""
    pairs = F.create_map(*(F.lit(x) if isinstance(x, str) else F.struct(F.lit(x[0]).alias("size"), F.lit(x[1]).alias("overlap")) for pair in V.CHUNKING.items() for x in pair))
    return F.coalesce(F.element_at(pairs, kind), F.element_at(pairs, F.lit("default")))


def cut(text: str, separator: str) -> list[str]:
    """The parts between separators, each separator at the head of the part after it; empty parts go."""
    if not separator:
        return list(text)
    ends = [m.start() for m in re.finditer(separator, text) if m.start() > 0]
    marks = [0, *ends, len(text)]
    return [text[a:b] for a, b in zip(marks, marks[1:], strict=False) if a < b]


def joined(parts: list[str], size: int, overlap: int, length: Length) -> list[str]:
    """Parts in runs of at most ``size``; a run begins with the last parts of the one before, up to the overlap."""
    found, held, lengths = [], [], []
    for part in parts:
        n = length(part)
        if held and sum(lengths) + n > size:
            if text := "".join(held).strip():
                found.append(text)
            while held and (sum(lengths) > overlap or sum(lengths) + n > size):
                del held[0], lengths[0]
        held.append(part)
        lengths.append(n)
    if text := "".join(held).strip():
        found.append(text)
    return found


def split(text: str, ladder: list[str], size: int, overlap: int, length: Length = len) -> list[str]:
    """Chunks of a text."""
    at = next((k for k, s in enumerate(ladder) if not s or re.search(s, text)), len(ladder) - 1)
    rest, found, short = ladder[at + 1 :], [], []
    for part in cut(text, ladder[at]):
        if length(part) < size:
            short.append(part)
            continue
        found += joined(short, size, overlap, length)
        short = []
        found += split(part, rest, size, overlap, length) if rest else [part]
    return found + joined(short, size, overlap, length)


def sections(text: str) -> list[tuple[list[str], str]]:
    """(headings from the top down, body) of Markdown: lines stripped, paragraphs joined by a Markdown line break; headings in fenced code are text."""
    found: list[tuple[list[str], str]] = []
    heads: list[tuple[int, str]] = []
    held: list[str] = []
    fence = ""

    def close() -> None:
        if held:
            own, body = [f"{'#' * level} {title}" for level, title in heads], "\n".join(held)
            held.clear()
            if found and found[-1][0] == own:
                found[-1] = own, f"{found[-1][1]}  \n{body}"
            else:
                found.append((own, body))

    for raw in text.split("\n"):
        line = "".join(filter(str.isprintable, raw.strip()))
        if fence:
            fence = "" if line.startswith(fence) else fence
            held.append(line)
        elif (line.startswith("```") and line.count("```") == 1) or line.startswith("~~~"):
            fence = line[:3]
            held.append(line)
        elif heading := HEADING.fullmatch(line):
            close()
            level = len(heading[1])
            heads[:] = [h for h in heads if h[0] < level] + [(level, (heading[2] or "").strip())]
        elif line:
            held.append(line)
        else:
            close()
    close()
    return [(h, body) for h, body in found if body.strip()]


def split_markdown(text: str, length: Length = len) -> list[str]:
    """Sections packed by characters; headings that two neighbours share are written once; a long section is split by its own ladder."""
    size, overlap = settings("md")
    found: list[str] = []
    held, last = "", []
    for heads, body in sections(text):
        shared = 0
        if held:
            while shared < min(len(heads), len(last)) and heads[shared] == last[shared]:
                shared += 1
        more = "\n".join([*heads[shared:], body])
        if held and len(held) + len(more) + 2 <= size:
            held, last = f"{held}\n\n{more}", heads
            continue
        if not held and len(more) <= size:
            held, last = more, heads
            continue
        if held:
            found.append(held)
        whole = "\n".join([*heads, body]).strip()
        if len(whole) > size:
            found += split(whole, SECTION, size, overlap, length)
            held, last = "", []
        else:
            held, last = whole, heads
    return [*found, held] if held else found


def split_by_kind(text: str, kind: str, length: Length = len) -> list[str]:
    if kind in MARKDOWN:
        return split_markdown(text, length)
    return split(text, LADDERS.get(kind, GENERAL), *settings(kind), length)


def clean_pdf(text: Column) -> Column:
    """Lines broken by the page joined again, paragraphs apart by one blank line, list marks and spaces made alike."""
    steps = [(r"(?<![。！？.!?])\n(?!\n)", " "), (r"\n{2,}", "\n\n"), (r"\n([•\-–])(?U)\s*", "\n$1 "), (r"\n(\d+(?:\.\d+)*\.)(?U)\s*", "\n$1 "), (" +", " "), (r"\A(?U)\s+|(?U)\s+\z", "")]
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return text


def chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", kind: str = "file_type", length: Length = len) -> DataFrame:
    """(key, chunk_index, chunk) of every document, by its type."""

    @pandas_udf(T.ArrayType(T.StringType()))
    def made(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([split_by_kind(t, k, length) if t else [] for t, k in zip(texts, kinds, strict=True)])

    own = docs.select(key, F.coalesce(F.lower(kind), F.lit("default")).alias("kind"), F.col(text).alias("text"))
    cleaned = F.when(F.col("kind") == "pdf", clean_pdf(F.col("text"))).otherwise(F.col("text"))
    return own.select(key, F.posexplode(made(cleaned, F.col("kind"))).alias("chunk_index", "chunk"))
