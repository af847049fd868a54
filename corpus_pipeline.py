"""The training-data pipeline: documents in, packed sequences out.

Every stage takes what the one before it kept. ``run`` writes each stage's rows to
the shared folder and reads them back, so that a lost executor costs one stage at
most.

Nulls and edge cases, in every stage: texts of any length are read whole; an empty
table gives an empty table; further columns of documents are left out, whatever
their names. In the stages' order: a null text and one without a letter go, and a
null lang teaches nothing; a document without an id is scored like any other, one
without ratings or labels at all stays; of near copies, ties included, the row with
the smallest id stays, rows that repeat an id with other texts are rows of their own,
and rows without an id stay; a passage stays in the document with the smallest id,
rows that repeat an id count as one document there; rows of any id are packed, each
for itself, equal lengths in the order in which they come.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasumi.llm import cdc, mixture_lid, ordinal, packing, simhash
from kasumi.llm.common import shared_path, table

#: Documents of these columns go from stage to stage.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: words of a shingle, and the Jaccard similarity that two documents' shingles must have.
NEAR = {"words": 5, "similarity": 0.8}


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text fits the languages that are learnt; those without a letter go. Where no document names its language, all with a letter stay."""
    model = mixture_lid.learn(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = mixture_lid.predict(docs, model, keep=COLUMNS, least=mixture_lid.LEAST_LIKENESS)
    return found.where(F.col("lang_pred") != mixture_lid.UNKNOWN).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of the best grade; toxic and poor ones go. Without ratings all stay."""
    model = ordinal.learn(docs, ordinal.grades(table(spark, sf_dir, "labels")), levels=3)
    if not model.weights.any():
        return docs.select(*COLUMNS)
    return ordinal.predict(docs, model, keep=COLUMNS, reach=2).where(F.col("tail_probability") >= ordinal.KEEP).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar, directly or through others, that with the smallest id."""
    return simhash.keep_first(docs.select(*COLUMNS), **NEAR)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that come in earlier ones."""
    found = cdc.deduplicate(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    path = public_tokenizers.path
    return packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("passages", no_repeated_passages),
    ("packing", packed),
]

#: Fitted models and tokenizers are beyond SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    path = shared_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
