"""Operators on spans: rows with a document's key and half-open offsets in code points.

A document's rows meet by its key alone, so all exchanges are on that key and the
windows of one step serve the next.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from kasumi.functions.text import colour, escaped


#: Lengths summed in one go by ``starts_of``.
SUMMED = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda's variable is, while an expression is computed in every place and at every step of a loop."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starts_of(lengths: Column) -> Column:
    """ARRAY<INT>: the sum of all lengths before each; in blocks, as an array that grows is copied at every step."""
    empty = F.array().cast("array<int>")

    def summed(values: Column, length: Callable[[Column], Column]) -> Column:
        zero = F.struct(F.lit(0).alias("at"), empty.alias("starts"))
        return F.aggregate(values, zero, lambda held, x: F.struct((held["at"] + length(x)).alias("at"), F.concat(held["starts"], F.array(held["at"])).alias("starts")))

    def whole(own: Column) -> Column:
        last = F.floor((F.greatest(F.size(own), F.lit(1)) - 1) / F.lit(SUMMED)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: summed(F.slice(own, k * SUMMED + 1, F.lit(SUMMED)), lambda x: x))
        return let(blocks, lambda made: F.flatten(F.zip_with(made, summed(made, lambda x: x["at"])["starts"], lambda block, base: F.transform(block["starts"], lambda x: x + base))))

    return let(lengths, whole)


def regex_hits(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<start, end, surface>> of all (non-empty) matches.

    Offsets are sums of the lengths of hits and gaps, as positions of Java's matcher count UTF-16 units.
    """

    def placed(pairs: Column) -> Column:
        starts = starts_of(F.transform(pairs, lambda x: F.length(x["gap"]) + F.length(x["hit"])))
        return F.zip_with(pairs, starts, lambda x, at: F.struct((at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("surface")))

    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    paired = F.zip_with(hits, gaps, lambda hit, gap: F.struct(hit.alias("hit"), gap.alias("gap")))
    return let(F.filter(paired, lambda x: x["hit"].isNotNull()), placed)  # the last gap has no hit


def regex_spans(docs: DataFrame, pattern: str, *, key: str = "doc_id", text: str = "text", needs: str | None = None) -> DataFrame:
    """(key, start, end, surface) of all matches. ``needs``: a character without which there is none, looked for first."""
    own = docs.where(F.contains(F.col(text), F.lit(needs))) if needs else docs
    own = own.where(F.col(text).rlike(pattern))
    return own.select(key, F.explode(regex_hits(F.col(text), pattern)).alias("hit")).select(key, "hit.start", "hit.end", "hit.surface")


def clusters(spans: DataFrame, by: list[str], *, name: str = "cluster") -> DataFrame:
    """The rows with the number of the group of overlapping spans they are in; touching spans are apart."""
    ties = [c for c in ("ord", "channel", "label") if c in spans.columns]  # both windows see one order
    order = Window.partitionBy(*by).orderBy("start", "end", *ties)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("start") < F.max("end").over(before), 0).otherwise(1)
    numbered = spans.withColumn("__fresh", fresh)
    return numbered.withColumn(name, F.sum("__fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__fresh")


def segments(spans: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end): the stretches that overlapping spans cover."""
    return clusters(spans, by, name="__segment").groupBy(*by, "__segment").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__segment")


def without_overlaps(spans: DataFrame, others: DataFrame, by: str = "doc_id") -> DataFrame:
    """The spans that no span of ``others`` overlaps."""
    a, b = spans.alias("a"), others.select(by, "start", "end").alias("b")
    return a.join(b, (F.col(f"a.{by}") == F.col(f"b.{by}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")), "left_anti")


def outermost(spans: DataFrame, by: list[str], *, order: str = "ord") -> DataFrame:
    """The spans that no longer span holds, and of equal ones the first; empty ones go. Partly overlapping ones all stay.

    A span goes if another holds it that is longer, or equal and earlier. As holding is transitive, this needs no order of removal: it is a window, not a join.
    """
    own = spans.where("start < end")
    line = Window.partitionBy(*by).orderBy("start", F.desc("end"), order)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("__reach", F.max("end").over(before)).where(F.col("__reach").isNull() | (F.col("__reach") < F.col("end"))).drop("__reach")


@pandas_udf(T.ArrayType(T.IntegerType()))
def _greedy(starts: pd.Series, ends: pd.Series) -> pd.Series:
    def kept(pair: tuple) -> list[int]:
        out, reach = [], None
        for k, (start, end) in enumerate(zip(*pair, strict=True)):
            if reach is None or start >= reach:
                out.append(k)
                reach = end
        return out

    return pd.Series([kept(p) for p in zip(starts, ends, strict=True)])


def _first_fitting(spans: DataFrame, by: str, order: Column, start: Column, end: Column) -> DataFrame:
    fields = [c for c in spans.columns if c != by]
    held = spans.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order.alias("__order"), start.alias("__start"), end.alias("__end"), *fields))).alias("held"))
    picked = held.withColumn("kept", _greedy(F.col("held.__start"), F.col("held.__end")))
    return picked.select(by, F.explode(F.transform("kept", lambda k: F.get("held", k))).alias("x")).select(by, *(F.col(f"x.{c}") for c in fields))


def leftmost_longest(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """From the left, at each place the longest span that begins where the last one kept has ended or later."""
    return _first_fitting(spans, by, F.struct("start", -F.col("end")), F.col("start"), F.col("end"))


def rightmost(spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """From the right, every span that ends where the last one kept begins or earlier; of equal starts the longest."""
    return _first_fitting(spans, by, F.struct(-F.col("start"), -F.col("end")), -F.col("end"), -F.col("start"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with an ascending array of STRUCT<start, end, placeholder> put in."""
    end = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(spans, k - 1)["end"])
    parts = F.transform(spans, lambda x, k: F.concat(F.substring(text, (end(k) + 1).cast("int"), (x["start"] - end(k)).cast("int")), x["placeholder"]))
    last = end(F.size(spans))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) < 1, text).otherwise(F.concat(F.array_join(parts, ""), F.substring(text, (last + 1).cast("int"), F.length(text))))


def mask(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, masked_text): every document with its spans' placeholders."""
    chosen = rightmost(spans.select(key, "start", "end", "placeholder").dropDuplicates([key, "start", "end"]), key)
    held = chosen.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder"))).alias("spans"))
    return docs.select(key, text).join(held, key, "left").select(key, replaced(F.col(text), F.col("spans")).alias("masked_text"))


def highlighted(docs: DataFrame, spans: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, html): texts with marked spans; of overlapping ones the first."""
    kept = leftmost_longest(spans.select(key, "start", "end", "label").dropDuplicates(), key)
    held = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    joined = docs.select(key, text).join(held, key, "left")
    body, spans_ = F.col(text), F.col("spans")
    end = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(spans_, k - 1)["end"])
    piece = lambda a, n: escaped(F.substring(body, (a + 1).cast("int"), n.cast("int")))
    marked = F.transform(
        spans_,
        lambda x, k: F.concat(piece(end(k), x["start"] - end(k)), F.lit('<mark style="background:'), colour(x["label"]), F.lit('">'), piece(x["start"], x["end"] - x["start"]), F.lit(" <small>"), escaped(x["label"]), F.lit("</small></mark>")),
    )
    whole = F.when(F.coalesce(F.size(spans_), F.lit(0)) < 1, escaped(body)).otherwise(F.concat(F.array_join(marked, ""), piece(end(F.size(spans_)), F.length(body))))
    return joined.select(key, F.replace(whole, F.lit("\n"), F.lit("<br>")).alias("html"))
