"""Scalar functions on text columns. All but the Unicode part of ``normalize`` run in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kasumi import values as V


def chars(characters: str) -> str:
    """A regular expression's class of these characters."""
    return "[" + "".join(f"\\{c}" if c in r"\[]^-&" else c for c in characters) + "]"


def either(column: Column, mapping: dict[str, str]) -> Column:
    """A literal map's value for a key, null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), column)


def _normal(text: str | None) -> str | None:
    return None if text is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", text).casefold())


@pandas_udf(T.StringType())
def _normalize_unicode(text: pd.Series) -> pd.Series:
    return text.map(_normal, na_action="ignore")


@pandas_udf(T.StringType())
def _nfkc_unicode(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A\p{ASCII}*\z")


def normalize_ascii(text: Column) -> Column:
    """``normalize`` for ASCII texts."""
    return F.lower(F.regexp_replace(text, r"[\s\x1c-\x1f]+", ""))


def normalize(text: Column) -> Column:
    """The key by which surfaces match: NFKC, case folded, without white space. Python sees only texts beyond ASCII."""
    return F.when(is_ascii(text), normalize_ascii(text)).otherwise(_normalize_unicode(F.when(~is_ascii(text), text)))


def nfkc(text: Column) -> Column:
    return F.when(is_ascii(text), text).otherwise(_nfkc_unicode(F.when(~is_ascii(text), text)))


def normal(text: str) -> str:
    """``normalize`` of a driver-side text."""
    return _normal(text) or ""


def looks_like_code(s: Column) -> Column:
    """Whether a surface has what names of people and companies don't: marks, digits, stray separators, a lone letter."""
    count = lambda cls: F.length(F.regexp_replace(s, f"[^{cls}]", ""))
    separators, dashes = chars(V.CJK_SEPARATORS), chars(V.DASHES)
    return (
        s.rlike(V.CODE_MARK)
        | ~s.rlike(V.NAME_CHARACTER)
        | s.rlike(r"\A[\x21-\x7e]*[0-9][\x21-\x7e]*\n?\z")
        | s.rlike(f"[A-Za-z]{separators}|{separators}[A-Za-z]")
        | s.rlike(f"\\A{dashes}|{dashes}\\n?\\z")
        | (count("(（") != count(")）"))
        | ((F.length(s) == 1) & ~s.rlike(V.KANJI))
    )


def nonperson_latin(s: Column) -> Column:
    """Whether a surface without Japanese letters has Latin words that aren't all in title case."""
    words = F.regexp_extract_all(s, F.lit("[A-Za-z]+"), F.lit(0))
    return ~s.rlike(V.JAPANESE_LETTER) & (F.size(words) > 0) & ~F.forall(words, lambda w: w.rlike(r"\A[A-Z][a-z]*\z"))


def jargon_caps(s: Column) -> Column:
    """Whether a surface is ASCII with capitals and without small letters."""
    return is_ascii(s) & s.rlike("[A-Z]") & ~s.rlike("[a-z]")


def has_separator(s: Column) -> Column:
    return s.rlike(chars(V.SEPARATORS))


def vote_category(channel: Column, label: Column) -> Column:
    """The category that a vote is for, null if none."""
    named = F.regexp_extract(label, r"\A([^(]*)", 1)
    by_tag = F.lit(None).cast("string")
    for prefix, category in V.POS_PREFIXES.items():
        by_tag = F.when(label.startswith(prefix), F.lit(category)).otherwise(by_tag)
    return (
        F.when(channel.isin(V.DICT, V.SESSION), F.when(named != "", named))
        .when(channel == V.REGEX, F.when(label != "", label))
        .when(channel == V.LLM, either(label, V.LLM_TYPES))
        .when(channel == V.POS, by_tag)
        .otherwise(either(F.upper(label), V.NER_LABELS))
    )


def category_rank(category: Column) -> Column:
    """0 for the most important; 99 for an unknown one."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, V.CATEGORIES)), category).cast("int"), F.lit(0)) - 1 + F.when(category.isin(V.CATEGORIES), 0).otherwise(100)


def confidence_rank(confidence: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for pair in V.CONFIDENCE.items() for x in pair))
    return F.coalesce(F.element_at(ranks, confidence), F.lit(0))


def identifier_subwords(s: Column) -> Column:
    """The parts of an identifier: runs of capitals, capitalised or small words, numbers."""
    return F.regexp_extract_all(s, F.lit(f"({V.SUBWORD})"), F.lit(1))


def content_hash(chunks: Column) -> Column:
    """SHA-256 of the chunks, a zero byte after each."""
    return F.sha2(F.encode(F.concat(F.array_join(chunks, "\x00"), F.when(F.size(chunks) > 0, F.lit("\x00")).otherwise(F.lit(""))), "UTF-8"), 256)


def context(text: Column, start: Column, end: Column, width: int = V.CONTEXT) -> Column:
    """The span between double angle brackets, with as much text on either side; dots where more follows."""
    left = F.greatest(start - width, F.lit(0))
    return F.concat(
        F.when(left > 0, F.lit("…")).otherwise(F.lit("")),
        F.substring(text, (left + 1).cast("int"), (start - left).cast("int")),
        F.lit("《"),
        F.substring(text, (start + 1).cast("int"), (end - start).cast("int")),
        F.lit("》"),
        F.substring(text, (end + 1).cast("int"), F.lit(width)),
        F.when(end + width < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )


def proper_subtype(tag: Column) -> Column:
    """What follows the proper-noun part of a tag; 一般 if nothing does, null for other tags."""
    parts = F.split(tag, "-")
    at = F.array_position(parts, "固有名詞")
    return F.when(at > 0, F.coalesce(F.get(parts, at.cast("int")), F.lit("一般")))


def is_interesting(tag: Column, entity: Column, unknown: Column) -> Column:
    return (F.coalesce(entity, F.lit("")) != "") | proper_subtype(tag).isNotNull() | F.coalesce(unknown, F.lit(False))


def confidence_label(confidence: Column) -> Column:
    """A label that sorts by strength, as reviews show it."""
    levels = {name: f"{k + 1} : {name}" for k, name in enumerate(V.CONFIDENCE)}
    return F.coalesce(either(confidence, levels), F.concat(F.lit("10 : "), confidence))


def colour(label: Column) -> Column:
    return F.coalesce(either(F.upper(label), V.COLOURS), F.lit(V.PLAIN_COLOUR))



def escaped(text: Column) -> Column:
    """For HTML."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
