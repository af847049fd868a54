"""Recognisers: tokens with tags and entities of prepared texts, from a model that the caller brings.

A model is a loader, called once in each task, that gives a function from a list of
texts to their analyses. Texts go to it in batches of a bounded number of
characters, each document piece by piece, so that neither a long document nor many
short ones make an allocation that grows with the input. A paragraph of more bytes
than a tokenizer takes is cut for the model only, best between lines; texts stay as
they are. Offsets come back as those of the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.functions.text import vote_category
from kasumi.operators.prepare import placed_pieces


@dataclass(frozen=True)
class Analysed:
    """Of one text: tokens (start, end, tag, unknown) and entities (start, end, label)."""

    tokens: tuple[tuple[int, int, str, bool], ...] = ()
    entities: tuple[tuple[int, int, str], ...] = ()


#: Loads a model: the result takes texts and gives an analysis of each.
Load = Callable[[], Callable[[list[str]], Iterable[Analysed]]]

ROWS = "i int, start int, end int, surface string, tag string, unknown boolean, label string"


def budgeted(texts: Iterable[str], most: int = V.BATCH_CHARS) -> Iterator[list[str]]:
    """Texts in order, as many at once as have at most ``most`` characters; a longer one alone."""
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def analysed(bodies: DataFrame, load: Load, *, key: str = "doc_id", most: int = V.BATCH_CHARS, longest: int = V.PIECE_BYTES) -> DataFrame:
    """(key, i, start, end, surface, tag, unknown, label) of (key, text): a row for each token that isn't white space, ``i`` counting up, and one with a label for each entity, without an ``i``."""
    kind = bodies.schema[key].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            pieces = []  # (row, where it begins, text)
            for row, text in enumerate(batch.column(1).to_pylist()):
                at = 0
                for piece in (text or "").split(V.CHUNK_JOINER):
                    pieces += [(row, at + start, part) for start, part in placed_pieces(piece, longest) if part.strip()]
                    at += len(piece) + len(V.CHUNK_JOINER)
            found = (x for group in budgeted((p for _, _, p in pieces), most) for x in model(group))
            rows: list[tuple] = []
            last, count = -1, 0
            for (row, at, piece), one in zip(pieces, found, strict=True):
                last, count = row, (count if row == last else 0)
                for start, end, tag, unknown in one.tokens:
                    if piece[start:end].strip():
                        rows.append((row, count, at + start, at + end, piece[start:end], tag, unknown, None))
                        count += 1
                rows += [(row, None, at + start, at + end, piece[start:end], None, None, label) for start, end, label in one.entities]
                if len(rows) > 50_000:
                    yield _batch(batch, rows, key)
                    rows = []
            if rows:
                yield _batch(batch, rows, key)

    return bodies.select(key, "text").mapInArrow(made, f"`{key}` {kind}, {ROWS}")


def _batch(batch: pa.RecordBatch, rows: list[tuple], key: str) -> pa.RecordBatch:
    kinds = pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()
    doc = batch.column(0).take(pa.array([r[0] for r in rows]))
    return pa.RecordBatch.from_arrays([doc, *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds))], names=[key, "i", "start", "end", "surface", "tag", "unknown", "label"])


def tokens_of(found: DataFrame) -> DataFrame:
    """The tokens of ``analysed`` rows."""
    return found.where("i is not null").drop("label")


def entities_of(found: DataFrame) -> DataFrame:
    """(key, start, end, surface, label) of the entities of ``analysed`` rows: what a detector gives."""
    return found.where("label is not null").drop("i", "tag", "unknown")


def tag_votes(tokens: DataFrame) -> DataFrame:
    """(key, start, end, surface, label) of tokens whose part of speech votes for a category; the tag is the label."""
    return tokens.where(vote_category(F.lit(V.POS), F.col("tag")).isNotNull()).withColumnRenamed("tag", "label").drop("i", "unknown")


def labelled_tokens(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``tokens_of`` with the label of the entity that covers them, or part of them, as ``entity``: for token reports."""
    t, e = tokens_of(found).alias("t"), entities_of(found).alias("e")
    meets = (F.col(f"t.{key}") == F.col(f"e.{key}")) & (F.col("t.start") < F.col("e.end")) & (F.col("e.start") < F.col("t.end"))
    own = [F.col(f"t.{c}") for c in (key, "i", "start", "end", "surface", "tag", "unknown")]
    return t.join(e, meets, "left").groupBy(*own).agg(F.min_by("e.label", "e.start").alias("entity"))
