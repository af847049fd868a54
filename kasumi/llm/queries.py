"""The queries over whole tables that apply this subpackage's operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasumi.llm import arc_warc, bpe_prefix, cdc, cws, html_text, maxscore, mixture_lid, ordinal, packing, simhash
from kasumi.llm.common import table


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every vector whose id 20 divides."""
    return maxscore.search(table(spark, sf_dir, "embeddings"), query="vec_id % 20 = 0", k=20, scale=64)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible text."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the component that links of at most 2 bits make."""
    found = simhash.near_components(simhash.fingerprints(table(spark, sf_dir, "documents"), width=3), radius=2)
    return found.select("doc_id", simhash.hexed("s0").alias("fingerprint"), "component_id")


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 tokens."""
    path = public_tokenizers.path
    return packing.pack_documents(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and that of its edited text."""
    return cws.fingerprint_edits(table(spark, sf_dir, "documents"))


def op6_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the WARC archives hold of every page."""
    return arc_warc.archive(table(spark, sf_dir, "pages"))


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the passages that come before, and the spans cut out."""
    found = cdc.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "removed")


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; a quarter of the ids is held out from learning."""
    docs = table(spark, sf_dir, "documents")
    model = mixture_lid.learn(docs, usable=~mixture_lid.held_out())
    found = mixture_lid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", mixture_lid.held_out().alias("held_out"), "lang_pred", "score", "languages")


def op10_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade (0 toxic, 1 poor, 2 good), the probability of good, and whether it stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.learn(docs, ordinal.grades(table(spark, sf_dir, "labels")), levels=3)
    found = ordinal.predict(docs, model, keep=["doc_id"], reach=2)
    return found.withColumn("kept", F.col("tail_probability") >= ordinal.KEEP)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoded text."""
    return bpe_prefix.digests(bpe_prefix.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op1_maxscore": op1_maxscore, "op2_html": op2_html, "op3_simhash": op3_simhash, "op4_best_fit": op4_best_fit, "op5_sampling": op5_sampling, "op6_archive": op6_archive, "op7_chunks": op7_chunks, "op8_mixture": op8_mixture, "op9_bpe": op9_bpe, "op10_ordinal": op10_ordinal}

#: The others are beyond SQL (tokenizers, fitted models, hashes that DuckDB lacks, packing in order); the tests hold them against plain Python.
ORACLES: dict[str, str] = {
    "op1_maxscore": """
with cells as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding) as x from embeddings),
whole as (select vec_id, i, cast(floor(64 * cast(x as double)) as bigint) as v from cells
    where vec_id not in (select vec_id from cells where x is null or not isfinite(x))),
scores as (select q.vec_id as query_id, r.vec_id, cast(sum(q.v * r.v) as bigint) as score from whole q join whole r on q.i = r.i and q.vec_id <> r.vec_id where q.vec_id % 20 = 0 group by all),
ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scores)
select query_id, rank, vec_id, score from ranked where rank <= 20
""",
}
