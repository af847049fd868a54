"""The whole plan: documents to candidates, a choice of candidates to masked texts and a mapping."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.functions.text import either, vote_category
from kasumi.operators import consensus, entities, prepare
from kasumi.operators.allowlist import Allowlist, exclude
from kasumi.operators.dictionary import Cut, Dictionary, cut_by_script, match, match_by_document, match_embedded, tokenized, tokens
from kasumi.operators.recognise import Load, analysed, tag_votes, tokens_of
from kasumi.operators.spans import leftmost_longest, mask, without_overlaps

def settled(df: DataFrame) -> DataFrame:
    """The rows computed once: in the shared checkpoint folder if there is one, else persisted. What comes after starts from a short plan."""
    spark = df.sparkSession
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not held.isDefined() and folder:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if held.isDefined() or folder else df.persist()


#: A detector takes (doc_id, text) and gives (doc_id, start, end, label), with or without the surface there.
Detector = Callable[[DataFrame], DataFrame]


@dataclass
class Analysis:
    """What was found, before anything is masked. Offsets are those of ``bodies``' text."""

    bodies: DataFrame
    tokenized: DataFrame
    candidates: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Frees what is persisted (without a checkpoint folder), once the results are written; checkpoints go by Spark's cleaner."""
        for rows in self.held:
            rows.unpersist()


@dataclass
class Masked:
    """``texts``: (doc_id, masked_text); ``spans``: in offsets of the original; ``mapping``: placeholders and surfaces."""

    texts: DataFrame
    spans: DataFrame
    mapping: DataFrame


@dataclass
class Masking:
    """The engine's settings. Detectors of entity recognisers go by channel name, in order of their votes.

    ``tagger`` is a model whose tokens vote by their parts of speech; its entities are not used. ``contacts`` are patterns
    of contact details, each with a character that they can't lack (or None).
    """

    dictionary: Dictionary = field(default_factory=Dictionary)
    detectors: dict[str, Detector] = field(default_factory=dict)
    llm: Detector | None = None
    allowlist: Allowlist | None = None
    flatten: bool = False
    promote: bool = True
    tokenizer: Cut = cut_by_script
    tagger: Load | None = None
    contacts: tuple[tuple[str, str | None], ...] = ((V.EMAIL, "@"),)

    def bodies(self, docs: DataFrame) -> DataFrame:
        """(doc_id, text, original_text, offset_map) of (doc_id, chunks)."""
        made = docs.select("doc_id", prepare.body(F.col("chunks"), flatten=self.flatten).alias("b"))
        return made.select("doc_id", "b.text", "b.original_text", "b.offset_map")

    def recognised(self, texts: DataFrame) -> DataFrame | None:
        """Raw votes of recognisers and the language model; a recogniser's span is cut where no name goes on."""
        found = None
        if self.tagger is not None:
            votes = tag_votes(tokens_of(analysed(texts, self.tagger)))
            found = votes.select("doc_id", "start", "end", F.lit(V.POS).alias("channel"), "label", vote_category(F.lit(V.POS), F.col("label")).alias("category"), F.lit(5).cast("long").alias("ord"))
        for k, (channel, detector) in enumerate(self.detectors.items()):
            spans = detector(texts).where(vote_category(F.lit(channel), F.col("label")).isNotNull())
            cut = spans if "surface" in spans.columns else consensus.with_surfaces(spans.select("doc_id", "start", "end", "label"), texts)
            parts = cut.select("doc_id", F.col("start").alias("at"), "label", F.explode(_uncut(F.col("surface"))).alias("p"))
            votes = parts.select("doc_id", (F.col("at") + F.col("p.start")).cast("int").alias("start"), (F.col("at") + F.col("p.end")).cast("int").alias("end"), F.lit(channel).alias("channel"), "label", vote_category(F.lit(channel), F.col("label")).alias("category"), F.lit(10 + k).cast("long").alias("ord"))
            found = votes if found is None else found.union(votes)
        if self.llm is not None:
            own = self.llm(texts)
            votes = own.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(V.LLM).alias("channel"), "label", F.coalesce(either(F.col("label"), V.LLM_TYPES), F.lit(V.OTHER)).alias("category"), F.lit(1000).cast("long").alias("ord"))
            found = votes if found is None else found.union(votes)
        return found

    def analyze(self, docs: DataFrame, extra_terms: DataFrame | None = None) -> Analysis:
        """Candidates of (doc_id, chunks). ``extra_terms``: (doc_id, surface, category) to promote as well."""
        spark = docs.sparkSession
        # dealt by document once: joins and windows on the document find the texts in their place
        bodies = settled(self.bodies(docs).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id"))
        texts = bodies.select("doc_id", "text")
        words = settled(tokenized(texts, cut=self.tokenizer)) if self.dictionary or self.promote or self.allowlist else tokenized(texts, cut=self.tokenizer)
        parts = [self.recognised(texts)]
        if self.dictionary:
            parts.append(_listed(match(words, self.dictionary), V.DICT, V.DICT_SUFFIX, 0))
            if any(t.embed for t in self.dictionary.terms):
                parts.append(_listed(match_embedded(words, self.dictionary), V.DICT, V.EMBED_SUFFIX, 1))
        votes = None
        for part in parts:
            if part is not None:
                votes = part if votes is None else votes.union(part)
        if votes is None:
            votes = texts.sparkSession.createDataFrame([], f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {consensus.RAW}")
        votes = settled(votes)
        candidates = consensus.resolve(votes, texts, anchored=bool(self.dictionary))
        if self.promote:
            terms = settled(consensus.promotable(candidates, extra_terms))
            again = _listed(match_by_document(words, terms), V.SESSION, V.SESSION_SUFFIX, 2)
            candidates = consensus.resolve(votes.union(again), texts)
        candidates = consensus.with_contacts(candidates, self.contact_spans(bodies))
        candidates = consensus.demote(candidates)
        if self.allowlist:
            candidates = exclude(candidates, self.allowlist, tokens(words))
        candidates = settled(candidates)
        return Analysis(bodies, words, candidates, [bodies, words, votes, *([terms] if self.promote else []), candidates])

    def contact_spans(self, bodies: DataFrame) -> DataFrame:
        """(doc_id, start, end, surface) of the patterns' matches, which padding doesn't cut; of overlapping ones the leftmost, then the longest."""
        found = [prepare.body_spans(bodies, pattern, needs=needs) for pattern, needs in self.contacts]
        if not found:
            return bodies.sparkSession.createDataFrame([], f"doc_id {bodies.schema['doc_id'].dataType.simpleString()}, start int, end int, surface string")
        return found[0] if len(found) == 1 else leftmost_longest(reduce(DataFrame.union, found))

    def expanded(self, analysis: Analysis, selected: DataFrame) -> DataFrame:
        """The selected candidates and all other occurrences of their surfaces, in order."""
        own = entities.keyed(selected.withColumn("ord", F.monotonically_increasing_id()) if "ord" not in selected.columns else selected)
        terms = own.where("entity <> ''").groupBy("doc_id", F.col("entity").alias("key_text")).agg(F.max_by("category", entities.strength(F.col("ord"))).alias("category"))
        more = without_overlaps(match_by_document(analysis.tokenized, terms), selected)
        surfaced = consensus.with_surfaces(more, analysis.bodies)
        vote = F.array(F.struct(F.lit(V.COLLECTED).alias("channel"), F.lit("展開").alias("label")))
        late = F.lit(1 << 40) + F.col("start")  # after all that was selected
        added = surfaced.select("doc_id", "start", "end", "surface", "category", F.lit(V.SURE).alias("confidence"), vote.alias("votes"), late.cast("long").alias("ord"))
        return selected.select(*added.columns).union(added)

    def apply(self, analysis: Analysis, selected: DataFrame, *, expand: bool = True) -> Masked:
        """Masks the selected candidates (doc_id, start, end, surface, category, confidence, votes), by entity or just where they are."""
        selected = entities.ordered(selected)
        spans = self.expanded(analysis, selected) if expand else selected
        original = settled(prepare.to_original(spans, analysis.bodies))
        placed = entities.placed(original, self.dictionary)
        texts = mask(analysis.bodies.select("doc_id", F.col("original_text").alias("text")), placed)
        return Masked(texts, original, entities.mapping(original, self.dictionary))

    def mask_documents(self, docs: DataFrame) -> tuple[Analysis, Masked]:
        """Analyses and masks what needs no review."""
        analysis = self.analyze(docs)
        return analysis, self.apply(analysis, entities.chosen_by_default(analysis.candidates))


def _listed(found: DataFrame, channel: str, suffix: str, order: int) -> DataFrame:
    return found.select("doc_id", "start", "end", F.lit(channel).alias("channel"), F.concat("category", F.lit(suffix)).alias("label"), "category", F.lit(order).cast("long").alias("ord"))


def _uncut(surface: Column) -> Column:
    """ARRAY<STRUCT<start, end>> of the stretches between characters that end a name."""
    from kasumi.functions.text import chars
    from kasumi.operators.spans import regex_hits

    return regex_hits(surface, "[^" + chars(V.SPAN_CUTS)[1:] + "+")


def chunked(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunks) of whole texts."""
    return docs.select(F.col(key).alias("doc_id"), F.array(F.coalesce(F.col(text), F.lit(""))).alias("chunks"))


def unmasked(masked: DataFrame, mapping: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """(key, text): masked texts with each placeholder's first surface put back, longer placeholders first."""
    table = mapping.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.length("placeholder")).alias("n"), "placeholder", F.get("surfaces", F.lit(0)).alias("surface")))).alias("table"))
    joined = masked.join(table, key, "left")
    return joined.select(key, F.aggregate(F.coalesce("table", F.array().cast("array<struct<n:int,placeholder:string,surface:string>>")), F.col("masked_text"), lambda text, x: F.replace(text, x["placeholder"], x["surface"])).alias("text"))
