"""Reports over candidates, tokens and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.functions.text import category_rank, confidence_label, confidence_rank, context, escaped, is_interesting, proper_subtype, vote_category


def counts(rows: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """(by, spans, documents), the most frequent first."""
    return rows.groupBy(by).agg(F.count("*").alias("spans"), F.countDistinct(key).alias("documents")).orderBy(F.desc("spans"), by)


def review(candidates: DataFrame, shown: tuple[str, ...] = V.SHOWN, docs: DataFrame | None = None) -> DataFrame:
    """Occurrences for review: what is masked first, then by confidence and surface; with ``docs`` also the text around."""
    own = candidates.where(F.col("confidence").isin(*shown)).withColumn("label", confidence_label(F.col("confidence"))).withColumn("mask", F.col("confidence").isin(*V.AUTO))
    if docs is not None:
        own = own.join(docs.select("doc_id", "text"), "doc_id").withColumn("context", context(F.col("text"), F.col("start"), F.col("end"))).drop("text")
    return own.orderBy(F.desc("mask"), F.desc(confidence_rank(F.col("confidence"))), "surface", "doc_id", "start")


def audit(candidates: DataFrame) -> DataFrame:
    """Candidates with channels by category, the category that most channels are for, and whether they disagree or it isn't the one decided."""
    own = candidates.withColumn("__v", F.explode("votes"))
    own = own.withColumn("vote", vote_category(F.col("__v.channel"), F.col("__v.label"))).where("vote is not null")
    keys = ["doc_id", "start", "end", "surface", "category", "confidence"]
    counted = own.groupBy(*keys, "vote").agg(F.countDistinct("__v.channel").alias("channels"))
    top = F.max_by("vote", F.struct("channels", -category_rank(F.col("vote"))))
    found = counted.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("vote", "channels")))).alias("tally"), F.count("*").alias("kinds"), top.alias("top"))
    return found.withColumn("split", (F.col("kinds") > 1) | (F.col("top") != F.col("category"))).drop("kinds")


def leak_report(leaks: DataFrame, *, redacted: bool = True) -> DataFrame:
    """Embedded terms of companies and trademarks: counts by category, or with the surfaces."""
    own = leaks.where(F.col("category").isin(V.COMPANY, V.TRADEMARK))
    return own.groupBy(*(["category"] if redacted else ["category", "canonical", "surface"])).agg(F.count("*").alias("tokens"))


def token_report(tokens: DataFrame, *, all_tokens: bool = False) -> DataFrame:
    """Tokens (tag, entity, unknown) with their proper-noun kind; uninteresting ones only if asked for."""
    own = tokens.withColumn("subtype", proper_subtype(F.col("tag")))
    return own if all_tokens else own.where(is_interesting(F.col("tag"), F.col("entity"), F.col("unknown")))


def token_summary(tokens: DataFrame) -> DataFrame:
    """(kind, value, tokens): proper nouns by kind, entity labels, unknown words, and proper nouns that have no label."""
    subtype, entity = proper_subtype(F.col("tag")), F.coalesce(F.col("entity"), F.lit(""))
    kinds: list[tuple[str, Column, Column]] = [
        ("proper", subtype, subtype.isNotNull()),
        ("entity", entity, entity != ""),
        ("unknown", F.lit("unknown"), F.coalesce(F.col("unknown"), F.lit(False))),
        ("gap", subtype, subtype.isNotNull() & (entity == "")),
    ]
    rows = F.array(*(F.when(which, F.struct(F.lit(kind).alias("kind"), value.alias("value"))) for kind, value, which in kinds))
    return tokens.select(F.explode(rows).alias("x")).where("x is not null").groupBy("x.kind", "x.value").agg(F.count("*").alias("tokens")).orderBy("kind", F.desc("tokens"), "value")


def drift(found: DataFrame, known: DataFrame, column: str = "type") -> DataFrame:
    """(type, drift): what is found and not known (new), and known and not found (gone)."""
    a, b = found.select(column).distinct(), known.select(column).distinct()
    return a.join(b, column, "left_anti").withColumn("drift", F.lit("new")).union(b.join(a, column, "left_anti").withColumn("drift", F.lit("gone")))


def labels(spans: DataFrame) -> DataFrame:
    """The labels that occur, in order."""
    return spans.select("label").distinct().orderBy("label")


def labelled(spans: DataFrame, wanted: list[str]) -> DataFrame:
    return spans.where(F.col("label").isin(*wanted))


def llm_view(spans: DataFrame, missing: DataFrame) -> DataFrame:
    """(doc_id, label, category, texts, found, missed): what the language-model detector says on its own, by type."""
    own = spans.groupBy("doc_id", "label").agg(F.count("*").alias("found"), F.sort_array(F.collect_set("surface")).alias("texts"))
    lost = missing.groupBy("doc_id", "label").agg(F.count("*").alias("missed"))
    both = own.join(lost, ["doc_id", "label"], "full")
    return both.select("doc_id", "label", F.coalesce(vote_category(F.lit(V.LLM), F.col("label")), F.lit(V.OTHER)).alias("category"), F.coalesce("texts", F.array().cast("array<string>")).alias("texts"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("missed", F.lit(0)).alias("missed"))


def state(documents: DataFrame, ner: DataFrame, llm: DataFrame, drafts: DataFrame) -> DataFrame:
    """(content_hash, loaded, recognised, detected, drafted): how far each document has come."""
    flag = lambda rows, name: rows.select("content_hash").distinct().withColumn(name, F.lit(True))
    own = documents.select("content_hash", (F.col("chunk_count") > 0).alias("loaded"))
    for rows, name in ((ner, "recognised"), (llm, "detected"), (drafts, "drafted")):
        own = own.join(flag(rows, name), "content_hash", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return own


def readable(masked: DataFrame, mapping: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, html): masked texts for a page, placeholders marked, line breaks kept; longer placeholders are marked first."""
    table = mapping.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.length("placeholder")).alias("n"), escaped(F.col("placeholder")).alias("p")))).alias("table"))
    marked = F.aggregate(F.coalesce("table", F.array().cast("array<struct<n:int,p:string>>")), escaped(F.col("masked_text")), lambda text, x: F.replace(text, x["p"], F.concat(F.lit("<mark>"), x["p"], F.lit("</mark>"))))
    return masked.join(table, key, "left").select(key, F.replace(marked, F.lit("\n"), F.lit("<br>")).alias("html"))


#: The form in which detections are stored.
DETECTION = "struct<spans:array<struct<start:int,end:int,label:string,reason:string,how:string>>,missing:array<struct<label:string,text:string>>>"


def detections(spans: DataFrame, missing: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, detections): a document's spans and misses as JSON."""
    own = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "reason", "how"))).alias("spans"))
    lost = missing.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("label", F.col("missing").alias("text")))).alias("missing"))
    return own.join(lost, key, "full").select(key, F.to_json(F.struct("spans", "missing")).alias("detections"))


def detected(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, end, label, reason, how) of stored detections."""
    parsed = stored.select(key, F.from_json("detections", DETECTION).alias("d"))
    return parsed.select(key, F.explode("d.spans").alias("s")).select(key, "s.*")


def timing_caption(name: Column, seconds: Column) -> Column:
    return F.concat(name, F.lit(" "), F.format_number(seconds, 1), F.lit(" s"))


def document_label(title: Column, identifier: Column) -> Column:
    """A document's title with its id, or the id alone."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(" ("), identifier, F.lit(")"))).otherwise(identifier)
