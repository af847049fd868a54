"""The curated dictionary: longest-match, embedded and audit joins with tokens.

Terms come from the driver, so their number is known. Up to ``BROADCAST_TERMS`` they
go to the tasks, and one pass over each document's tokens finds the matches without
a shuffle. Beyond that, tokens make n-grams (within the lengths that keys have) that
are joined with the terms by shuffle; both ways give the same rows.

Tokenized documents are rows (key, text, starts, ends), two arrays of offsets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.functions.text import normal, normalize
from kasumi.operators.spans import leftmost_longest

BROADCAST_TERMS = 200_000
#: Words of Latin letters and digits, runs of one Japanese script, other characters alone.
TOKEN = r"[A-Za-z0-9À-ÖØ-öø-ɏ]+|[ぁ-ゖ]+|[ァ-ヺー]+|[㐀-䶿一-鿿]+|\S"
#: Distinct tokens of which a task remembers what they hold, and documents it looks through before it hands over what it found.
REMEMBERED, AT_ONCE = 50_000, 100


@dataclass(frozen=True)
class Term:
    canonical: str
    category: str
    aliases: tuple[str, ...] = ()
    mask: str = ""
    embed: bool = False


@dataclass
class Dictionary:
    """Terms by normalised surface. Of equal keys the later term counts."""

    terms: list[Term] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.keys())

    def keys(self) -> dict[str, Term]:
        return {key: term for term in self.terms for surface in (term.canonical, *term.aliases) if (key := normal(surface))}

    def frame(self, spark: SparkSession) -> DataFrame:
        """(key, canonical, category, mask, embed)."""
        masks = {t.canonical: t.mask for t in self.terms if t.mask}
        rows = [(key, t.canonical, t.category, masks.get(t.canonical), t.embed) for key, t in self.keys().items()]
        return spark.createDataFrame(rows, "key string, canonical string, category string, mask string, embed boolean")


def sized(terms: DataFrame, n: int) -> DataFrame:
    """With a hint to broadcast if there are few enough."""
    return F.broadcast(terms) if n <= BROADCAST_TERMS else terms


Cut = Callable[[str], tuple[list[int], list[int]]]


def cut_by_script(text: str) -> tuple[list[int], list[int]]:
    """The default tokenizer; white space makes no token."""
    spans = [m.span() for m in re.finditer(TOKEN, text)]
    return [a for a, _ in spans], [b for _, b in spans]


def tokenized(docs: DataFrame, *, key: str = "doc_id", text: str = "text", cut: Cut = cut_by_script) -> DataFrame:
    """(key, text, starts, ends). Another tokenizer (a morphological one, say) goes in as ``cut``, which is loaded once in each task.

    The default one is a pattern that the JVM could match too, but not give offsets of without interpreted array functions.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for body in batch.column(1).to_pylist():
                a, b = cut(body or "")
                if cut is not cut_by_script:
                    kept = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if body[x:y].strip()]
                    a, b = [a[k] for k in kept], [b[k] for k in kept]
                starts.append(a)
                ends.append(b)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=[key, text, "starts", "ends"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(made, f"`{key}` {kind}, `{text}` string, starts array<int>, ends array<int>").withColumnRenamed(text, "text")


def tokens(tokenized_docs: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, i, start, end, surface), a row per token. Surfaces are cut here, as a substring in the JVM counts from the text's beginning each time."""
    kind = tokenized_docs.schema[key].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths().fill_null(0))
            lows = np.concatenate([[0], np.cumsum(sizes)])
            starts, ends = (batch.column(c).flatten() for c in (2, 3))
            first = 0
            while first < batch.num_rows:  # as many documents as have about 50,000 tokens
                after = max(first + 1, int(np.searchsorted(lows, lows[first] + 50_000, side="right")) - 1)
                own = slice(int(lows[first]), int(lows[after]))
                a, b = starts[own.start : own.stop], ends[own.start : own.stop]
                doc = np.repeat(np.arange(first, after), sizes[first:after])
                place = np.arange(own.start, own.stop) - lows[doc]
                x, y = a.to_pylist(), b.to_pylist()
                surfaces: list[str] = []
                for k in range(first, after):
                    if sizes[k]:
                        text, low = batch.column(1)[k].as_py(), int(lows[k]) - own.start
                        surfaces += [text[p:q] for p, q in zip(x[low : low + int(sizes[k])], y[low : low + int(sizes[k])], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(place.astype(np.int32)), a, b, pa.array(surfaces, pa.string())], names=[key, "i", "start", "end", "surface"])
                first = after

    return tokenized_docs.select(key, "text", "starts", "ends").mapInArrow(listed, f"`{key}` {kind}, i int, start int, end int, surface string")


def key_of(surface: str) -> str:
    return surface.lower() if surface.isascii() else normal(surface)


def longest_matches(units: list[str], terms: dict, longest: int, most: int = V.MAX_TOKENS) -> Iterator[tuple[int, int, object]]:
    """(first, after, value) of the longest term at each place, going on behind it."""
    i, n = 0, len(units)
    while i < n:
        text, found = "", None
        for j in range(i, min(i + most, n)):
            text += units[j]
            if len(text) > longest:
                break
            if text in terms:
                found = j + 1, terms[text]
        if found:
            yield i, *found
            i = found[0]
        else:
            i += 1


def _scan(tokenized_docs: DataFrame, key: str, find: Callable[[str, list[int], list[int], object], Iterator[tuple[int, int, str, str]]], extra: str | None = None) -> DataFrame:
    """(key, start, end, canonical, category): what ``find`` gives for each document, in one pass."""
    kind = tokenized_docs.schema[key].dataType.simpleString()

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):  # what is found can be several times the text
                batch = whole.slice(at, AT_ONCE)
                docs, rows = [], []
                more = batch.column(4).to_pylist() if extra else [None] * batch.num_rows
                for doc, text, starts, ends, own in zip(*(c.to_pylist() for c in batch.columns[:4]), more, strict=True):
                    found = list(find(text or "", starts, ends, own))
                    rows += found
                    docs += [doc] * len(found)
                columns = [pa.array(docs, batch.schema.field(0).type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string())))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "end", "canonical", "category"])

    return tokenized_docs.select(key, "text", "starts", "ends", *([extra] if extra else [])).mapInArrow(scanned, f"`{key}` {kind}, start int, end int, canonical string, category string")


def grams(tokenized_docs: DataFrame, longest: int, most: int = V.MAX_TOKENS, *, key: str = "doc_id") -> DataFrame:
    """(key, start, end, canonical, category): runs of tokens, their normalised text in ``canonical``; for joins by shuffle."""

    def runs(text: str, starts: list[int], ends: list[int], _: object) -> Iterator[tuple[int, int, str, str]]:
        units = [key_of(text[a:b]) for a, b in zip(starts, ends, strict=True)]
        for i in range(len(units)):
            run = ""
            for j in range(i, min(i + most, len(units))):
                run += units[j]
                if len(run) > longest:
                    break
                yield starts[i], ends[j], run, ""

    return _scan(tokenized_docs, key, runs)


def match(tokenized_docs: DataFrame, dictionary: Dictionary, *, key: str = "doc_id", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(key, start, end, canonical, category): from the left, at each token the longest term that begins there, no two overlapping."""
    keys = dictionary.keys()
    longest = max(map(len, keys), default=0)
    if len(keys) > broadcast_terms:
        terms = dictionary.frame(tokenized_docs.sparkSession).select(F.col("key").alias("run"), "canonical", "category")
        hits = grams(tokenized_docs, longest, key=key).select(key, "start", "end", F.col("canonical").alias("run")).join(terms, "run")
        return leftmost_longest(hits.select(key, "start", "end", "canonical", "category"), key)
    terms = {k: (t.canonical, t.category) for k, t in keys.items()}

    def find(text: str, starts: list[int], ends: list[int], _: object) -> Iterator[tuple[int, int, str, str]]:
        units = [key_of(text[a:b]) for a, b in zip(starts, ends, strict=True)]
        for i, j, value in longest_matches(units, terms, longest):
            yield starts[i], ends[j - 1], *value

    return _scan(tokenized_docs, key, find)


def match_by_document(tokenized_docs: DataFrame, terms: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, start, end, category): ``match`` with terms of each document's own, (key, key_text, category)."""
    own = terms.groupBy(key).agg(F.collect_list(F.struct("key_text", "category")).alias("own"))  # as many as the document has surfaces

    def find(text: str, starts: list[int], ends: list[int], held: list[dict]) -> Iterator[tuple[int, int, str, str]]:
        known = {t["key_text"]: t["category"] for t in held}
        units = [key_of(text[a:b]) for a, b in zip(starts, ends, strict=True)]
        for i, j, category in longest_matches(units, known, max(map(len, known))):
            yield starts[i], ends[j - 1], "", category

    return _scan(tokenized_docs.join(own, key), key, find, "own").drop("canonical")


def match_embedded(tokenized_docs: DataFrame, dictionary: Dictionary, *, key: str = "doc_id", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(key, start, end, canonical, category): terms marked ``embed`` among the sub-words of compound tokens; what one token holds never runs on into the next."""
    terms = {k: (t.canonical, t.category) for k, t in dictionary.keys().items() if t.embed}
    longest = max(map(len, terms), default=0)
    if len(terms) > broadcast_terms:
        rows = tokenized_docs.sparkSession.createDataFrame([(k, *v) for k, v in terms.items()], "run string, canonical string, category string")
        hits = _embedded_grams(tokenized_docs, longest, key).join(rows, "run")
        # of one token, named by its beginning, the leftmost and longest
        own = F.struct(F.col(key).alias("doc"), F.col("token"))
        kept = leftmost_longest(hits.select(own.alias("own"), "start", "end", "canonical", "category"), "own")
        return kept.select(F.col("own.doc").alias(key), "start", "end", "canonical", "category")

    seen: dict[str, list[tuple[int, int, str, str]]] = {}  # a task's tokens so far, at most REMEMBERED

    def inside(token: str) -> Iterator[tuple[int, int, str, str]]:
        subs = [m.span() for m in re.finditer(V.SUBWORD, token)]
        if len(subs) > 1:
            for i, j, value in longest_matches([key_of(token[x:y]) for x, y in subs], terms, longest):
                yield subs[i][0], subs[j - 1][1], *value

    def find(text: str, starts: list[int], ends: list[int], _: object) -> Iterator[tuple[int, int, str, str]]:
        for a, b in zip(starts, ends, strict=True):
            found = seen.get(token := text[a:b])
            if found is None:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                found = list(inside(token))
                if b - a <= 64:
                    seen[token] = found
            for x, y, canonical, category in found:
                yield a + x, a + y, canonical, category

    return _scan(tokenized_docs, key, find)


def _embedded_grams(tokenized_docs: DataFrame, longest: int, key: str) -> DataFrame:
    """(key, start, end, token, run): runs of sub-words inside compound tokens, their normalised text; ``token``: where the token begins."""

    def runs(text: str, starts: list[int], ends: list[int], _: object) -> Iterator[tuple[int, int, str, str]]:
        for a, b in zip(starts, ends, strict=True):
            subs = [m.span() for m in re.finditer(V.SUBWORD, text[a:b])]
            for i in range(len(subs) if len(subs) > 1 else 0):
                run = ""
                for j in range(i, min(i + V.MAX_TOKENS, len(subs))):
                    run += key_of(text[a + subs[j][0] : a + subs[j][1]])
                    if len(run) > longest:
                        break
                    yield a + subs[i][0], a + subs[j][1], run, str(a)

    return _scan(tokenized_docs, key, runs).select(key, "start", "end", F.col("category").cast("int").alias("token"), F.col("canonical").alias("run"))


def leaks(token_rows: DataFrame, dictionary: Dictionary, *, key: str = "doc_id", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(key, i, surface, canonical, category): tokens that hold a term without being one; an audit.

    Distinct tokens are compared with terms, not every occurrence: each in one pass over an automaton of all terms, or,
    with more terms than go to the tasks, by joining the parts of a token that have a term's length.
    """
    spark, keys = token_rows.sparkSession, dictionary.keys()
    known = token_rows.select("surface").distinct().withColumn("n", normalize(F.col("surface")))
    inner = {k: (t.canonical, t.category, rank) for rank, (k, t) in enumerate(keys.items()) if len(k) >= 2}
    if len(keys) > broadcast_terms:
        terms = spark.createDataFrame([(k, t.canonical, t.category, rank) for rank, (k, t) in enumerate(keys.items())], "term string, canonical string, category string, rank int")
        whole = known.join(terms.select(F.col("term").alias("n")), "n", "left_anti")
        lengths = F.array(*(F.lit(n) for n in sorted({len(k) for k in inner})))
        places = lambda size: F.sequence(F.lit(1), F.length("n") - size + 1)
        fitting = F.filter(lengths, lambda size: size <= F.length("n"))
        parts = whole.select("surface", F.explode(F.array_distinct(F.flatten(F.transform(fitting, lambda size: F.transform(places(size), lambda at: F.substring("n", at, size)))))).alias("term"))
        held = parts.join(terms, "term").select("surface", "canonical", "category", "rank")
    else:

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = automaton(inner)
            for batch in batches:
                rows = [(surface, *value) for surface, n in zip(*(c.to_pylist() for c in batch.columns), strict=True) if n and n not in keys for value in {v for _, v in held.iter(n)}] if inner else []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int32()))], names=["surface", "canonical", "category", "rank"])

        held = known.mapInArrow(found, "surface string, canonical string, category string, rank int")
    first = held.groupBy("surface", "canonical").agg(F.min_by("category", "rank").alias("category"))
    return token_rows.join(first, "surface").select(key, "i", "surface", "canonical", "category")


def automaton(terms: dict[str, object]) -> ahocorasick.Automaton:
    held = ahocorasick.Automaton()
    for term, value in terms.items():
        held.add_word(term, value)
    held.make_automaton()
    return held
