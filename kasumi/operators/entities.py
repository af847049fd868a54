"""Entities: occurrences of one surface (or of one dictionary term) in a document, their choice and their placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kasumi import values as V
from kasumi.functions.text import category_rank, confidence_rank, either, normalize
from kasumi.operators.dictionary import Dictionary, sized


def keyed(candidates: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """With entity, canonical (null without a term) and mask."""
    own = candidates.withColumn("__n", normalize(F.col("surface")))
    if not dictionary:
        return own.withColumn("canonical", F.lit(None).cast("string")).withColumn("mask", F.lit(None).cast("string")).withColumnRenamed("__n", "entity")
    terms = dictionary.frame(candidates.sparkSession).select(F.col("key").alias("__n"), "canonical", "mask")
    joined = own.join(sized(terms, len(dictionary.keys())), "__n", "left")
    return joined.withColumn("entity", F.when(F.col("canonical").isNotNull(), normalize(F.col("canonical"))).otherwise(F.col("__n"))).drop("__n")


def strength(ord_: Column) -> Column:
    """Sorts the best representative last: the most confident, then the most important category, then the first."""
    return F.struct(confidence_rank(F.col("confidence")), -category_rank(F.col("category")), -ord_)


def ordered(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """With ord, the place of a candidate in its document."""
    return candidates.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("start", "end")).cast("long"))


def groups(candidates: DataFrame, dictionary: Dictionary | None = None, *, key: str = "doc_id") -> DataFrame:
    """(key, entity, first, surface, category, confidence, votes, count): a row per entity, ``first`` its place in order."""
    own = keyed(ordered(candidates, key), dictionary)
    best = F.max_by(F.struct(F.coalesce("canonical", "surface").alias("surface"), "category", "confidence"), strength(F.col("ord")))
    votes = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "votes"))), lambda x: x["votes"])))
    found = own.groupBy(key, "entity").agg(F.min("ord").alias("first"), best.alias("best"), votes.alias("votes"), F.count("*").alias("count"))
    return found.select(key, "entity", "first", "best.surface", "best.category", "best.confidence", "votes", "count")


def chosen_by_default(candidates: DataFrame) -> DataFrame:
    """Occurrences that are masked without review."""
    return candidates.where(F.col("confidence").isin(*V.AUTO))


def chosen_by_entity(candidates: DataFrame, dictionary: Dictionary | None = None, *, key: str = "doc_id") -> DataFrame:
    """All occurrences of entities of which one is masked without review."""
    own = keyed(candidates, dictionary)
    sure = F.max(F.col("confidence").isin(*V.AUTO).cast("int")).over(Window.partitionBy(key, "entity"))
    return own.withColumn("__sure", sure).where("__sure = 1").select(*candidates.columns)


def with_draft(automatic: DataFrame, added: DataFrame, removed: DataFrame, by: list[str]) -> DataFrame:
    """The automatic choice with a reviewer's additions and without the removals."""
    return automatic.select(*by).union(added.select(*by)).distinct().join(removed.select(*by), by, "left_anti")


def draft_of(selected: DataFrame, automatic: DataFrame, by: list[str]) -> DataFrame:
    """(by, change): what a reviewer added to and removed from the automatic choice."""
    added = selected.select(*by).distinct().join(automatic.select(*by), by, "left_anti").withColumn("change", F.lit("added"))
    return added.union(automatic.select(*by).distinct().join(selected.select(*by), by, "left_anti").withColumn("change", F.lit("removed")))


def numbered(spans: DataFrame, dictionary: Dictionary | None = None, *, key: str = "doc_id") -> DataFrame:
    """(key, entity, category, placeholder): one placeholder for each entity of a document.

    Numbers count up by category in the order in which entities come first (``ord``); an entity with a mask of its own takes no number.
    """
    own = keyed(spans, dictionary)
    found = own.groupBy(key, "entity").agg(F.min("ord").alias("first"), F.max_by("category", strength(F.col("ord"))).alias("category"), F.min_by("mask", "ord").alias("mask"))
    line = Window.partitionBy(key, "category", F.col("mask").isNull()).orderBy("first")
    name = F.concat(F.lit("["), F.coalesce(either(F.col("category"), V.PREFIXES), F.lit(V.UNNAMED_PREFIX)), F.row_number().over(line).cast("string"), F.lit("]"))
    return found.select(key, "entity", "first", "category", F.coalesce("mask", name).alias("placeholder"))


def mapping(spans: DataFrame, dictionary: Dictionary | None = None, *, key: str = "doc_id") -> DataFrame:
    """(key, placeholder, category, surfaces): the table that takes a mask back."""
    own = keyed(spans, dictionary)
    surfaces = own.groupBy(key, "entity").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "surface"))), lambda x: x["surface"])).alias("surfaces"))
    return numbered(spans, dictionary, key=key).join(surfaces, [key, "entity"]).select(key, "first", "placeholder", "category", "surfaces")


def placed(spans: DataFrame, dictionary: Dictionary | None = None, *, key: str = "doc_id") -> DataFrame:
    """(key, start, end, surface, placeholder)."""
    own = keyed(spans, dictionary)
    names = numbered(spans, dictionary, key=key).select(key, "entity", "placeholder")
    return own.join(names, [key, "entity"]).select(key, "start", "end", "surface", "placeholder")
