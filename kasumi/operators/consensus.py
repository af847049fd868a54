"""From raw votes to candidates: clusters, anchors, two systems' opinions, levels of confidence.

Raw votes are rows (key, start, end, channel, label, category, ord); ``ord`` is the
place in the order of producers, which decides between equals. Candidates are rows
(key, start, end, surface, category, confidence, votes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kasumi import values as V
from kasumi.functions.text import category_rank, has_separator, jargon_caps, looks_like_code, nonperson_latin, normalize, vote_category
from kasumi.operators.spans import clusters, segments, without_overlaps

RAW = "start int, end int, channel string, label string, category string, ord long"


def grouped(raw: DataFrame, key: str = "doc_id") -> DataFrame:
    """Raw votes with their category and rank, their cluster of overlapping spans and its extent, and whether a dictionary's term (an anchor) is in it. One exchange, on the key."""
    own = clusters(raw, [key]).withColumn("vote", vote_category(F.col("channel"), F.col("label"))).withColumn("rank", category_rank(F.col("vote")))
    whole = Window.partitionBy(key, "cluster")
    anchor = F.col("channel").isin(V.DICT, V.SESSION)
    return own.withColumn("e_start", F.min("start").over(whole)).withColumn("e_end", F.max("end").over(whole)).withColumn("anchored", F.max(anchor).over(whole))


def split_by_anchors(own: DataFrame, key: str = "doc_id") -> DataFrame:
    """``grouped`` votes of anchored clusters beside each span that is made of theirs and that they overlap.

    Each anchor is a span, and so is each stretch of other votes that neither hold an anchor nor lie in one.
    """
    votes = own.where("anchored").drop("e_start", "e_end")
    is_anchor = F.col("channel").isin(V.DICT, V.SESSION)
    anchors = votes.where(is_anchor).select(key, "cluster", "start", "end").distinct()
    m, a = votes.where(~is_anchor).alias("m"), anchors.alias("a")
    same = (F.col(f"m.{key}") == F.col(f"a.{key}")) & (F.col("m.cluster") == F.col("a.cluster"))
    holds = (F.col("m.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("m.end"))
    within = (F.col("a.start") <= F.col("m.start")) & (F.col("m.end") <= F.col("a.end"))
    left = m.join(a, same & (holds | within), "left_anti").select(key, "cluster", "start", "end")
    spans = anchors.union(segments(left, [key, "cluster"]).select(key, "cluster", "start", "end")).distinct()
    e, m = spans.select(F.col(key).alias("e_key"), F.col("cluster").alias("e_cluster"), F.col("start").alias("e_start"), F.col("end").alias("e_end")), votes
    return m.join(e, (F.col(key) == F.col("e_key")) & (F.col("cluster") == F.col("e_cluster")) & (F.col("start") < F.col("e_end")) & (F.col("e_start") < F.col("end"))).drop("e_key", "e_cluster")


def opinions(votes: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row per span (e_start, e_end): what each system says of it, in one aggregation."""
    channel, vote, rank = F.col("channel"), F.col("vote"), F.col("rank")
    place = F.struct("start", "end", "ord")
    recogniser = ~channel.isin(*V.DECISIVE, V.LLM) & vote.isNotNull()
    return votes.groupBy(key, F.col("e_start").alias("start"), F.col("e_end").alias("end")).agg(
        F.max(recogniser & (vote == V.PERSON)).alias("person"),
        F.max(recogniser & (vote == V.COMPANY)).alias("company"),
        F.min(F.when(recogniser & ~vote.isin(V.PERSON, V.COMPANY), rank)).alias("rest"),
        F.min(F.when((channel == V.LLM) & vote.isNotNull(), rank)).alias("llm"),
        F.min_by(vote, F.when((channel == V.DICT) & vote.isNotNull(), place)).alias("listed"),
        F.min_by("category", place).alias("fallback"),
        F.collect_set(F.when(channel == V.SESSION, vote)).alias("confirmed"),
        F.array_sort(F.collect_list(F.struct("start", "end", "ord", "channel", "label"))).alias("members"),
    )


def decided(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates of ``opinions`` that have their surface.

    Each system gives its most important category; recognisers' votes for people or companies count as 'other' if the surface looks like code (for people also if it isn't in title case). A dictionary vote decides alone.
    """
    ranks = {c: k for k, c in enumerate(V.CATEGORIES)}
    other, minor = ranks[V.OTHER], [ranks[V.PLACE], ranks[V.OTHER]]
    own = spans.withColumn("code", looks_like_code(F.col("surface"))).withColumn("nonperson", nonperson_latin(F.col("surface")))
    person = F.when(F.col("person"), F.when(F.col("code") | F.col("nonperson"), F.lit(other)).otherwise(F.lit(ranks[V.PERSON])))
    company = F.when(F.col("company"), F.when(F.col("code"), F.lit(other)).otherwise(F.lit(ranks[V.COMPANY])))
    own = once(own, "ner", F.least(person, company, "rest"))
    special = (F.col("ner").isNotNull() & ~F.col("ner").isin(minor)).cast("int") + (F.col("llm").isNotNull() & ~F.col("llm").isin(minor)).cast("int")
    own = own.withColumn("best", F.least("ner", "llm")).withColumn("special", special)  # best is null only if both are
    own = own.withColumn("found", F.coalesce(F.get(F.array(*map(F.lit, V.CATEGORIES)), "best"), "fallback", F.lit(V.OTHER)))
    level = F.when(F.col("best").isNull(), V.MEDIUM).when(F.col("special") >= 2, V.STRONG).when(F.col("special") == 1, V.MEDIUM).otherwise(V.WEAK)
    strong = ~F.col("found").isin(V.PLACE, V.OTHER) & F.array_contains("confirmed", F.col("found"))
    votes = F.array_distinct(F.transform("members", lambda m: F.struct(m["channel"].alias("channel"), m["label"].alias("label"))))
    return own.select(key, "start", "end", "surface", F.coalesce("listed", "found").alias("category"), F.when(F.col("listed").isNotNull(), V.SURE).when(strong, V.STRONG).otherwise(level).alias("confidence"), votes.alias("votes"))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """With a column that is computed once a row: expressions aren't copied through a generator, while through a projection each use would compute it anew."""
    return rows.select(*(c for c in rows.columns if c != name), F.explode(F.array(value)).alias(name))


def with_surfaces(spans: DataFrame, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans with what the text has there; texts meet the spans of their own document only."""
    found = spans.join(docs.select(key, F.col(text).alias("__text")), key)
    return once(found, "surface", F.substring("__text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("__text")


def resolve(raw: DataFrame, docs: DataFrame, *, key: str = "doc_id", text: str = "text", anchored: bool = True) -> DataFrame:
    """Raw votes to candidates: a cluster is one, or several if there are anchors in it. ``anchored``: False if there can't be any."""
    own = grouped(raw, key)
    found = opinions(own.where(~F.col("anchored")) if anchored else own, key)
    if anchored:
        found = found.union(opinions(split_by_anchors(own, key), key))
    return decided(with_surfaces(found, docs, key=key, text=text), key)


def promotable(candidates: DataFrame, extra: DataFrame | None = None, *, key: str = "doc_id") -> DataFrame:
    """(key, key_text, category): strong surfaces without separators, neither places nor others, the first of a key; then ``extra``'s (key, surface, category)."""
    strong = candidates.where((F.col("confidence") == V.STRONG) & ~F.col("category").isin(V.PLACE, V.OTHER) & ~has_separator(F.col("surface")))
    own = strong.select(key, normalize(F.col("surface")).alias("key_text"), "category", F.lit(0).alias("late"), "start", "end")
    if extra is not None:
        more = extra.where(~has_separator(F.col("surface"))).select(key, normalize(F.col("surface")).alias("key_text"), "category", F.lit(1).alias("late"), F.lit(0).alias("start"), F.lit(0).alias("end"))
        own = own.union(more)
    return own.where("key_text <> ''").groupBy(key, "key_text").agg(F.min_by("category", F.struct("late", "start", "end")).alias("category"))


def with_contacts(candidates: DataFrame, contacts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Candidates that no contact overlaps, and the contacts: (key, start, end, surface)."""
    vote = F.array(F.struct(F.lit(V.REGEX).alias("channel"), F.lit(V.CONTACT).alias("label")))
    own = contacts.select(key, "start", "end", "surface", F.lit(V.CONTACT).alias("category"), F.lit(V.STRONG).alias("confidence"), vote.alias("votes"))
    return without_overlaps(candidates, contacts, key).select(*own.columns).union(own)


def demote(candidates: DataFrame) -> DataFrame:
    """Medium and weak candidates that look like code, are capitals only or of no named kind become faint, unless the language model calls them identifiers."""
    s, c = F.col("surface"), F.col("category")
    identifier = F.exists("votes", lambda v: (v["channel"] == V.LLM) & v["label"].isin(*V.LLM_IDENTIFIERS))
    doubtful = looks_like_code(s) | (jargon_caps(s) & ~c.isin(V.COMPANY, V.TRADEMARK)) | (c == V.OTHER)
    return candidates.withColumn("confidence", F.when(F.col("confidence").isin(V.MEDIUM, V.WEAK) & ~identifier & doubtful, F.lit(V.FAINT)).otherwise(F.col("confidence")))


def tally(votes: DataFrame, by: list[str]) -> DataFrame:
    """(by, category, channels): how many channels vote for each category; for audits, not for decisions."""
    named = votes.withColumn("category", vote_category(F.col("channel"), F.col("label"))).where("category is not null")
    return named.groupBy(*by, "category").agg(F.countDistinct("channel").alias("channels"))
