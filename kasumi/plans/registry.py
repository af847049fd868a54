"""Named queries over the driver tables and their DuckDB counterparts.

Recognisers are third-party models; here regular expressions stand in for them, so
that every step after them can be held against SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kasumi import values as V
from kasumi.functions import text as T
from kasumi.operators import chunking, consensus, dictionary, entities, prepare, spans, store, windows
from kasumi.operators.allowlist import Allowlist, exclude
from kasumi.operators.dictionary import Dictionary, Term
from kasumi.plans import reports
from kasumi.plans.masking import Masking, chunked, unmasked

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name, with its SQL if it has any."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of an input that can't be split (one row group, say) over the cores, where less than a quarter of these would work; larger inputs stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 4 * rows.rdd.getNumPartitions() <= cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cases(column: str, mapping: dict[str, object], default: str = "null") -> str:
    """A SQL CASE of a map."""
    return f"case {column} " + " ".join(f"when {quoted(k)} then {quoted(v) if isinstance(v, str) else v}" for k, v in mapping.items()) + f" else {default} end"


def spans_sql(source: str, pattern: str, more: str = "") -> str:
    """(doc_id, i, start, end, surface) of all matches in ``source``'s text."""
    p = quoted(pattern)
    return f"""select doc_id, i, s as start, s + length(h[i]) as "end", h[i] as surface from (
    select doc_id, h, i, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) as bigint) as s
    from (select doc_id, h, g, unnest(range(1, len(h) + 1)) as i from (select doc_id, regexp_extract_all(text, {p}) as h, string_split_regex(text, {p}) as g from {source} where regexp_matches(text, {p}) {more})))"""


# --- detectors that stand in for models ------------------------------------------------------------

#: (channel, label, pattern), in order of their votes.
STAND_INS = [
    ("model_a", "PERSON", "[A-Z][a-zß-ÿ]{5,} [a-zß-ÿ]{4,}"),
    ("model_b", "COMPANY", "[A-Z][a-zß-ÿ]{7,}"),
    ("model_b", "City", "[a-zß-ÿ]{9,}"),
    (V.LLM, "Person", "[A-Z][a-zß-ÿ]{6,}"),
    (V.LLM, "Account", "[0-9]{5,}"),
]
VOTES_SQL = " union all ".join(f"select doc_id, start, \"end\", {quoted(c)} as channel, {quoted(label)} as label, {k} as ord from ({spans_sql('documents', p)})" for k, (c, label, p) in enumerate(STAND_INS))


def votes(docs: DataFrame) -> DataFrame:
    """Raw votes of the stand-ins."""
    found = None
    for k, (channel, label, pattern) in enumerate(STAND_INS):
        own = spans.regex_spans(docs, pattern).select("doc_id", "start", "end", F.lit(channel).alias("channel"), F.lit(label).alias("label"), T.vote_category(F.lit(channel), F.lit(label)).alias("category"), F.lit(k).cast("long").alias("ord"))
        found = own if found is None else found.union(own)
    return found


def longs(df: DataFrame) -> DataFrame:
    """Offsets and counts as longs."""
    return df.select(*(F.col(c).cast("long").alias(c) if kind == "int" else F.col(c) for c, kind in df.dtypes))


# --- contacts --------------------------------------------------------------------------------------

CONTACTS_SQL = spans_sql("documents", V.EMAIL, "and contains(text, '@')")


def contacts(docs: DataFrame) -> DataFrame:
    return spans.regex_spans(docs, V.EMAIL, needs="@")


@query(f'select doc_id, start, "end", surface from ({CONTACTS_SQL})')
def contact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(contacts(documents(spark, sf_dir)))


NUMBERED_SQL = f"""contacts as ({CONTACTS_SQL}),
keyed as (select *, lower(surface) as entity from contacts),
firsts as (select doc_id, entity, min(start) as first from keyed group by all),
numbered as (select doc_id, entity, first, '[{V.PREFIXES[V.CONTACT]}' || row_number() over (partition by doc_id order by first) || ']' as placeholder from firsts)"""


def placed_contacts(docs: DataFrame) -> DataFrame:
    candidates = consensus.with_contacts(docs.sparkSession.createDataFrame([], CANDIDATES), contacts(docs))
    return entities.ordered(candidates)


CANDIDATES = "doc_id long, start int, end int, surface string, category string, confidence string, votes array<struct<channel:string,label:string>>"


@query(f"""with {NUMBERED_SQL},
parts as (select k.doc_id, k.start, k."end", n.placeholder, lag(k."end", 1, 0) over (partition by k.doc_id order by k.start) as before from keyed k join numbered n using (doc_id, entity)),
put as (select p.doc_id, string_agg(substring(d.text, p.before + 1, p.start - p.before) || p.placeholder, '' order by p.start) as body, max(p."end") as last from parts p join documents d using (doc_id) group by p.doc_id)
select doc_id, body || substring(text, last + 1) as masked_text from put join documents using (doc_id)""")
def contact_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with contacts, those masked by entity."""
    docs = documents(spark, sf_dir)
    placed = entities.placed(placed_contacts(docs))
    return spans.mask(docs.where(F.contains("text", F.lit("@"))), placed).join(placed.select("doc_id").distinct(), "doc_id", "left_semi")


@query(f"with {NUMBERED_SQL} select doc_id, first as \"first\", entity, placeholder, {quoted(V.CONTACT)} as category from (select doc_id, entity, placeholder, row_number() over (partition by doc_id order by first) as first from numbered)")
def placeholder_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = placed_contacts(documents(spark, sf_dir))
    own = entities.numbered(found)
    line = F.dense_rank().over(spans.Window.partitionBy("doc_id").orderBy("first"))
    return own.select("doc_id", line.cast("long").alias("first"), "entity", "placeholder", "category")


@query(f"""select c.doc_id, c.start, c."end",
case when c.start > {V.CONTEXT} then '…' else '' end || substring(text, greatest(c.start - {V.CONTEXT}, 0) + 1, c.start - greatest(c.start - {V.CONTEXT}, 0)) || '《' || c.surface || '》' || substring(text, c."end" + 1, {V.CONTEXT}) || case when c."end" + {V.CONTEXT} < length(text) then '…' else '' end as context
from ({CONTACTS_SQL}) c join documents d using (doc_id)""")
def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return longs(contacts(docs).join(docs, "doc_id").select("doc_id", "start", "end", T.context(F.col("text"), F.col("start"), F.col("end")).alias("context")))


@query(f"select doc_id, entity, category, count(*) as occurrences from (select doc_id, lower(surface) as entity, {quoted(V.CONTACT)} as category from ({CONTACTS_SQL})) group by all")
def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.groups(placed_contacts(documents(spark, sf_dir)).drop("ord")).select("doc_id", "entity", "category", F.col("count").alias("occurrences"))


# --- tokens and the dictionary ---------------------------------------------------------------------

TERMS = Dictionary([Term("of the", V.COMPANY, ("ofthe",)), Term("the", V.TRADEMARK, (), "[T]"), Term("and the", V.PERSON), Term("de la", V.PERSON, ("della",)), Term("thtion", V.COMPANY), Term("mit der", V.PLACE)])
KEYS_SQL = "(values " + ", ".join(f"({quoted(k)}, {quoted(t.canonical)}, {quoted(t.category)}, {n})" for n, (k, t) in enumerate(TERMS.keys().items())) + ") as terms(term, canonical, category, rank)"
TOKENS_SQL = f"select doc_id, i, start, \"end\", surface from ({spans_sql('documents', dictionary.TOKEN)}) where not regexp_full_match(surface, '\\s*')"
LONGEST = max(map(len, TERMS.keys()))


@query(f'select doc_id, count(*) as n, cast(sum(start) as bigint) as starts, cast(sum("end") as bigint) as ends, min(surface) as least, max(surface) as most from ({TOKENS_SQL}) group by doc_id')
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, summed up."""
    own = dictionary.tokens(dictionary.tokenized(documents(spark, sf_dir)))
    return own.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"), F.min("surface").alias("least"), F.max("surface").alias("most"))


HITS_SQL = f"""with tokens as (select doc_id, row_number() over (partition by doc_id order by i) as i, start, "end", lower(surface) as n from ({TOKENS_SQL})),
runs as (select doc_id, start, {", ".join(f'lead("end", {k}) over w as e{k}' for k in range(LONGEST))}, {", ".join(f"n || " + " || ".join(["''", *(f"lead(n, {j}) over w" for j in range(1, k + 1))]) + f" as n{k}" for k in range(LONGEST))} from tokens window w as (partition by doc_id order by i)),
grams as ({" union all ".join(f'select doc_id, start, e{k} as "end", n{k} as term from runs where length(n{k}) <= {LONGEST}' for k in range(LONGEST))}),
hits as (select doc_id, list({{'s': start, 'e': "end", 'c': canonical, 'g': category}} order by start, "end" desc) as hits from grams join {KEYS_SQL} using (term) group by doc_id),
kept as (select doc_id, unnest(list_reduce(list_transform(hits, lambda h: [h]), lambda kept, h: case when h[1].s >= kept[-1].e then kept || h else kept end)) as h from hits)"""


@query(f'{HITS_SQL} select doc_id, h.s as start, h.e as "end", h.c as canonical, h.g as category from kept')
def dict_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(dictionary.match(dictionary.tokenized(documents(spark, sf_dir)), TERMS))


@query(f'{HITS_SQL} select doc_id, h.s as start, h.e as "end", h.c as canonical, h.g as category from kept')
def dict_matches_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a shuffled join, as for dictionaries that are too large for the tasks."""
    return longs(dictionary.match(dictionary.tokenized(documents(spark, sf_dir)), TERMS, broadcast_terms=0))


@query(f"""with words as (select surface, count(*) as n from ({TOKENS_SQL}) group by surface),
held as (select surface, n, canonical, category, row_number() over (partition by surface, canonical order by rank) as k from words join {KEYS_SQL} on contains(lower(surface), term) and length(term) >= 2 where lower(surface) not in (select term from {KEYS_SQL}))
select canonical, category, count(*) as surfaces, cast(sum(n) as bigint) as tokens from held where k = 1 group by all""")
def dict_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dictionary.leaks(dictionary.tokens(dictionary.tokenized(documents(spark, sf_dir))), TERMS)
    return found.groupBy("canonical", "category").agg(F.countDistinct("surface").alias("surfaces"), F.count("*").alias("tokens"))


EMBEDDED = Dictionary([Term("Foo", V.COMPANY, ("Bar",), "", True), Term("th", V.TRADEMARK, (), "", True)])


@query()
def embedded_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked terms inside compound tokens. Every word is made into a compound with the next one here, over the whole text."""
    compound = F.regexp_replace("text", "(?<![A-Za-z])([A-Za-z]++)(?=[^A-Za-z]++([A-Za-z]++))", "$1Foo$2")
    made = documents(spark, sf_dir).select("doc_id", compound.alias("text"))
    return longs(dictionary.match_embedded(dictionary.tokenized(made), EMBEDDED))


# --- spans -----------------------------------------------------------------------------------------

CLUSTERS_SQL = f"""votes as ({VOTES_SQL}),
marked as (select *, case when start < max("end") over (partition by doc_id order by start, "end", ord rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from votes),
clustered as (select *, sum(fresh) over (partition by doc_id order by start, "end", ord rows between unbounded preceding and current row) as cluster from marked),
merged as (select doc_id, cluster, min(start) as start, max("end") as "end", count(*) as n from clustered group by doc_id, cluster)"""


@query(f'with {CLUSTERS_SQL} select doc_id, start, "end", n from merged')
def span_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spans.clusters(votes(documents(spark, sf_dir)), ["doc_id"])
    return longs(own.groupBy("doc_id", "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("cluster"))


@query(f'select v.doc_id, v.start, v."end", v.channel, v.label from ({VOTES_SQL}) v where not exists (select 1 from ({CONTACTS_SQL}) c where c.doc_id = v.doc_id and v.start < c."end" and c.start < v."end")')
def overlap_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return longs(spans.without_overlaps(votes(docs), contacts(docs)).select("doc_id", "start", "end", "channel", "label"))


@query(f"""with votes as ({VOTES_SQL}) select a.doc_id, a.start, a."end", a.label from votes a
where not exists (select 1 from votes b where b.doc_id = a.doc_id and b.start <= a.start and a."end" <= b."end" and (b.start < a.start or a."end" < b."end" or b.ord < a.ord))""")
def llm_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that no longer one holds."""
    return longs(spans.outermost(votes(documents(spark, sf_dir)), ["doc_id"]).select("doc_id", "start", "end", "label"))


# --- predicates ------------------------------------------------------------------------------------

SEPARATOR_SQL, DASH_SQL = "[" + V.CJK_SEPARATORS + "]", "[" + V.DASHES.replace("-", "") + "-]"


def code_sql(s: str) -> str:
    return f"""(regexp_matches({s}, {quoted(V.CODE_MARK)}) or not regexp_matches({s}, '{V.NAME_CHARACTER}') or regexp_full_match({s}, '[\\x21-\\x7e]*[0-9][\\x21-\\x7e]*')
or regexp_matches({s}, '[A-Za-z]{SEPARATOR_SQL}|{SEPARATOR_SQL}[A-Za-z]') or regexp_matches({s}, '^{DASH_SQL}|{DASH_SQL}$')
or length(regexp_replace({s}, '[^(（]', '', 'g')) <> length(regexp_replace({s}, '[^)）]', '', 'g')) or (length({s}) = 1 and not regexp_matches({s}, '{V.KANJI}')))"""


def nonperson_sql(s: str) -> str:
    words = f"regexp_extract_all({s}, '[A-Za-z]+')"
    return f"(not regexp_matches({s}, '{V.JAPANESE_LETTER}') and len({words}) > 0 and len(list_filter({words}, lambda w: not regexp_full_match(w, '[A-Z][a-z]*'))) > 0)"


def jargon_sql(s: str) -> str:
    return f"(regexp_full_match({s}, '[\\x00-\\x7f]*') and regexp_matches({s}, '[A-Z]') and not regexp_matches({s}, '[a-z]'))"


WORDS_SQL = "select distinct unnest(string_split_regex(text, '[ \\n]+')) as surface from documents"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.explode(F.split("text", "[ \n]+")).alias("surface")).distinct().where("surface <> ''")


@query(f"select surface, {code_sql('surface')} as code from ({WORDS_SQL}) where surface <> ''")
def code_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("surface", T.looks_like_code(F.col("surface")).alias("code"))


@query(f"select surface, {nonperson_sql('surface')} as nonperson from ({WORDS_SQL}) where surface <> ''")
def nonperson_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("surface", T.nonperson_latin(F.col("surface")).alias("nonperson"))


@query(f"select surface, {jargon_sql('surface')} as jargon from ({WORDS_SQL}) where surface <> ''")
def jargon_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("surface", T.jargon_caps(F.col("surface")).alias("jargon"))


@query(f"select surface, array_to_string(regexp_extract_all(regexp_replace(surface, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), '/') as subwords from ({WORDS_SQL}) where surface <> ''")
def identifier_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("surface", F.array_join(T.identifier_subwords(F.col("surface")), "/").alias("subwords"))


# --- consensus -------------------------------------------------------------------------------------

RANKS = {c: k for k, c in enumerate(V.CATEGORIES)}
VOTE_SQL = f"case when channel = 'llm' then {cases('label', V.LLM_TYPES)} else {cases('upper(label)', V.NER_LABELS)} end"
CANDIDATES_SQL = f"""{CLUSTERS_SQL},
surfaced as (select m.doc_id, m.cluster, m.start, m."end", substring(d.text, m.start + 1, m."end" - m.start) as surface from merged m join documents d using (doc_id)),
judged as (select *, {code_sql('surface')} as code, {nonperson_sql('surface')} as nonperson, {jargon_sql('surface')} as jargon from surfaced),
ranked as (select j.*, c.channel, c.label, c.start as vs, c."end" as ve, c.ord, {VOTE_SQL} as vote from judged j join clustered c using (doc_id, cluster)),
opinions as (select doc_id, start, "end", surface, code, jargon,
    min(case when channel <> 'llm' and vote is not null then case when (vote = '{V.PERSON}' and (code or nonperson)) or (vote = '{V.COMPANY}' and code) then {RANKS[V.OTHER]} else {cases('vote', RANKS)} end end) as ner,
    min(case when channel = 'llm' then {cases('vote', RANKS)} end) as llm, bool_or(channel = 'llm' and label in {V.LLM_IDENTIFIERS}) as identifier, count(distinct channel || label) as votes
    from ranked group by all),
candidates as (select doc_id, start, "end", surface, code, jargon, identifier, votes, {cases('cast(least(coalesce(ner, 99), coalesce(llm, 99)) as varchar)', {str(k): c for c, k in RANKS.items()})} as category,
    case cast(coalesce(ner, 9) < {RANKS[V.PLACE]} as integer) + cast(coalesce(llm, 9) < {RANKS[V.PLACE]} as integer) when 2 then '{V.STRONG}' when 1 then '{V.MEDIUM}' else '{V.WEAK}' end as confidence from opinions)"""
ENTITY_SQL = "replace(lower(regexp_replace(surface, '\\s+', '', 'g')), 'ß', 'ss')"
DEMOTED_SQL = f"case when confidence in ('{V.MEDIUM}', '{V.WEAK}') and not identifier and (code or (jargon and category not in ('{V.COMPANY}', '{V.TRADEMARK}')) or category = '{V.OTHER}') then '{V.FAINT}' else confidence end"


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return consensus.resolve(votes(docs), docs, anchored=False)


@query(f'with {CANDIDATES_SQL} select doc_id, start, "end", surface, category, confidence, votes from candidates')
def vote_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(resolved(spark, sf_dir).withColumn("votes", F.size("votes")))


@query(f'with {CANDIDATES_SQL} select doc_id, start, "end", {DEMOTED_SQL} as confidence from candidates')
def demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(consensus.demote(resolved(spark, sf_dir)).select("doc_id", "start", "end", "confidence"))


@query(f"with named as (select doc_id, channel, {VOTE_SQL} as category from ({VOTES_SQL})) select doc_id, category, count(distinct channel) as channels from named where category is not null group by doc_id, category")
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.tally(votes(documents(spark, sf_dir)), ["doc_id"])


ALLOWED = Allowlist.of(["Released", "Thtion", "Inther", "Reached"])


@query(f"""with {CANDIDATES_SQL} select confidence, category, count(*) as candidates from (select category, case when {ENTITY_SQL} in ({", ".join(map(quoted, sorted(ALLOWED.exact)))}) then '{V.EXCLUDED}' else {DEMOTED_SQL} end as confidence from candidates) group by all""")
def allowlist_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exclude(consensus.demote(resolved(spark, sf_dir)), ALLOWED)
    return found.groupBy("confidence", "category").agg(F.count("*").alias("candidates"))


@query(f"""with {CANDIDATES_SQL}, sure as (select *, max(cast(confidence in ('{V.SURE}', '{V.STRONG}') as integer)) over (partition by doc_id, {ENTITY_SQL}) as sure from candidates)
select doc_id, start, "end", surface from sure where sure = 1""")
def auto_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(entities.chosen_by_entity(resolved(spark, sf_dir)).select("doc_id", "start", "end", "surface"))


@query(f"""with {CANDIDATES_SQL}, grouped as (select doc_id, {ENTITY_SQL} as entity, category, {cases('confidence', V.CONFIDENCE)} as rank, {cases('category', RANKS)} as cat, start, "end" from candidates),
best as (select *, row_number() over (partition by doc_id, entity order by rank desc, cat, start, "end") as k, count(*) over (partition by doc_id, entity) as occurrences from grouped)
select doc_id, entity, category, occurrences from best where k = 1""")
def entity_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the category of their best occurrence."""
    return entities.groups(resolved(spark, sf_dir)).select("doc_id", "entity", "category", F.col("count").alias("occurrences"))


@query()
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan over all documents: dictionary, stand-ins, promotion, contacts, demotion, allowlist, masking."""
    masking = stand_in_masking()
    _, masked = masking.mask_documents(chunked(documents(spark, sf_dir)))
    return masked.texts


def stand_in_masking(**options) -> Masking:
    def detector(channel: str):
        def detect(texts: DataFrame) -> DataFrame:
            return votes(texts).where(F.col("channel") == channel).select("doc_id", "start", "end", "label")

        return detect

    terms = Dictionary([Term("Released", V.COMPANY), Term("MIT License", V.TRADEMARK, (), "[licence]")])
    return Masking(terms, {"model_a": detector("model_a"), "model_b": detector("model_b")}, detector(V.LLM), ALLOWED, **options)


@query()
def masked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the whole plan by category and confidence."""
    return stand_in_masking().analyze(chunked(documents(spark, sf_dir))).candidates.groupBy("category", "confidence").agg(F.count("*").alias("candidates"))


@query()
def mask_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, masked = stand_in_masking().mask_documents(chunked(documents(spark, sf_dir)))
    return masked.mapping.select("doc_id", "placeholder", "category", F.array_join("surfaces", "/").alias("surfaces"))


@query("select doc_id, text from documents")
def unmask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts masked and put back: the documents themselves, as every entity has one surface."""
    docs = documents(spark, sf_dir)
    found = placed_contacts(docs)
    return unmasked(spans.mask(docs, entities.placed(found)), entities.mapping(found))


# --- preparation -----------------------------------------------------------------------------------


@query(f"""with lines as (select doc_id, i, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))),
parted as (select *, list_filter(list_transform(string_split(line, '|'), lambda c: trim(c, chr(32) || chr(9) || chr(13))), lambda c: c <> '') as cells from lines),
flat as (select doc_id, i, case when not contains(line, '|') then line when len(cells) = 0 then '' else array_to_string(cells, '{V.CELL_JOINER}') || '{V.ROW_END}' end as line from parted
where not (contains(line, '|') and len(cells) > 0 and len(list_filter(cells, lambda c: not regexp_full_match(c, ':?-+:?'))) = 0))
select doc_id, string_agg(line, chr(10) order by i) as text from flat group by doc_id""")
def flatten_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", prepare.flatten_tables(F.col("text")).alias("text"))


OPEN_SQL, CLOSE_SQL = "[(\\[{（［｛〔【]", "[)\\]}）］｝〕】]"


def twice(text: str, pattern: str, put: str) -> str:
    """A replacement of neighbouring matches, which RE2 can't do by looking around."""
    return f"regexp_replace(regexp_replace({text}, '{pattern}', '{put}', 'g'), '{pattern}', '{put}', 'g')"


@query(f"select doc_id, {twice(twice(twice('text', f'({CLOSE_SQL})({OPEN_SQL})', chr(92) + '1  ' + chr(92) + '2'), f'([^ {chr(92)}s])({OPEN_SQL})', chr(92) + '1 ' + chr(92) + '2'), f'({CLOSE_SQL})([^ {chr(92)}s])', chr(92) + '1 ' + chr(92) + '2')} as text from documents")
def pad_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", prepare.pad_brackets(F.col("text")).alias("text"))


@query("""with a as (select doc_id, regexp_replace(regexp_replace(text, '([^。！？.!?\\n])\\n([^\\n])', '\\1 \\2', 'g'), '([^。！？.!?\\n])\\n([^\\n])', '\\1 \\2', 'g') as t from documents),
b as (select doc_id, regexp_replace(t, '\\n{2,}', chr(10) || chr(10), 'g') as t from a),
c as (select doc_id, regexp_replace(regexp_replace(t, '\\n([•\\-–])\\s*', chr(10) || '\\1 ', 'g'), '\\n(\\d+(?:\\.\\d+)*\\.)\\s*', chr(10) || '\\1 ', 'g') as t from b)
select doc_id, trim(regexp_replace(t, ' +', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) as text from c""")
def pdf_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", chunking.clean_pdf(F.col("text")).alias("text"))


PADDED_SQL = twice(twice(twice("flat", f"({CLOSE_SQL})({OPEN_SQL})", chr(92) + "1  " + chr(92) + "2"), f"([^ {chr(92)}s])({OPEN_SQL})", chr(92) + "1 " + chr(92) + "2"), f"({CLOSE_SQL})([^ {chr(92)}s])", chr(92) + "1 " + chr(92) + "2")


@query(f"""with lines as (select doc_id, i, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))),
parted as (select *, list_filter(list_transform(string_split(line, '|'), lambda c: trim(c, chr(32) || chr(9) || chr(13))), lambda c: c <> '') as cells from lines),
flattened as (select doc_id, i, line, case when not contains(line, '|') then line when len(cells) = 0 or len(list_filter(cells, lambda c: not regexp_full_match(c, ':?-+:?'))) = 0 then '' else array_to_string(cells, '{V.CELL_JOINER}') || '{V.ROW_END}' end as flat from parted),
padded as (select doc_id, i, line, {PADDED_SQL} as text from flattened),
kept as (select * from padded where regexp_matches(text, '\\S'))
select d.doc_id, coalesce(string_agg(k.text, chr(10) || chr(10) order by k.i), '') as text, coalesce(string_agg(k.line, chr(10) || chr(10) order by k.i), '') as original_text from documents d left join kept k using (doc_id) group by d.doc_id""")
def prepared_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared bodies of documents, a chunk for each line, beside the originals that offsets lead back to."""
    made = documents(spark, sf_dir).select("doc_id", prepare.body(F.split("text", "\n"), flatten=True).alias("b"))
    return made.select("doc_id", "b.text", "b.original_text")


@query("""with recursive lines as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line, whole from (select doc_id, string_split(text, chr(10)) as l, strlen(text) as whole from documents)),
chars as (select doc_id, i, unnest(range(1, length(line) + 1)) as pos, line from lines where whole > 2000 and strlen(line) > 2000),
summed as (select doc_id, i, pos, sum(strlen(substring(line, pos, 1))) over (partition by doc_id, i order by pos) as bytes from chars),
cuts as (select doc_id, i, cast(0 as bigint) as after, cast(0 as hugeint) as bytes from (select distinct doc_id, i from chars)
union all select c.doc_id, c.i, max(s.pos), max(s.bytes) from cuts c join summed s on s.doc_id = c.doc_id and s.i = c.i and s.pos > c.after and s.bytes <= c.bytes + 2000 group by c.doc_id, c.i),
long as (select c.doc_id, c.i, row_number() over (partition by c.doc_id, c.i order by c.after) as part, substring(l.line, c.before + 1, c.after - c.before) as text from (select *, lag(after) over (partition by doc_id, i order by after) as before from cuts) c join lines l on l.doc_id = c.doc_id and l.i = c.i where c.before is not null),
walk as (select doc_id, i, 0 as run, strlen(line) as held from lines where i = 1 and whole > 2000
union all select l.doc_id, l.i, case when w.held > 0 and w.held <= 2000 and w.held + 1 + strlen(l.line) <= 2000 then w.run else w.run + 1 end, case when w.held > 0 and w.held <= 2000 and w.held + 1 + strlen(l.line) <= 2000 then w.held + 1 + strlen(l.line) else strlen(l.line) end from walk w join lines l on l.doc_id = w.doc_id and l.i = w.i + 1),
short as (select w.doc_id, min(w.i) as i, 0 as part, string_agg(l.line, chr(10) order by w.i) as text from walk w join lines l on l.doc_id = w.doc_id and l.i = w.i where strlen(l.line) <= 2000 group by w.doc_id, w.run)
select doc_id, cast(row_number() over (partition by doc_id order by i, part) - 1 as bigint) as piece, text from (select * from short where text <> '' union all select * from long) union all select doc_id, 0, text from documents where strlen(text) <= 2000""")
def byte_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,000 bytes."""
    own = documents(spark, sf_dir).select("doc_id", F.posexplode(prepare.byte_safe(F.col("text"), 2000)).alias("piece", "text"))
    return longs(own.select("doc_id", "piece", "text"))


PARAGRAPHS_SQL = "select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents"
SEGMENTS_SQL = f"""parts as (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as i from ({PARAGRAPHS_SQL})),
placed as (select doc_id, i, part, coalesce(sum(length(part) + 2) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start from parts),
segs as (select doc_id, cast(row_number() over (partition by doc_id order by i) as bigint) as k, cast(start as bigint) as start, cast(start + length(part) as bigint) as "end", length(part) as n from placed where regexp_matches(part, '\\S'))"""


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query(f'with {SEGMENTS_SQL} select doc_id, start, "end", n from segs')
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = paragraphs(spark, sf_dir).select("doc_id", F.explode(windows.segments(F.col("text"))).alias("s"))
    return longs(own.select("doc_id", "s.start", "s.end", "s.n"))


WALK_SQL = f"""{SEGMENTS_SQL},
walk as (select doc_id, k, start, "end", n, 0 as win, n as held from segs where k = 1
union all select s.doc_id, s.k, s.start, s."end", s.n, case when w.held + s.n <= 1000 then w.win else w.win + 1 end, case when w.held + s.n <= 1000 then w.held + s.n else s.n end from walk w join segs s on s.doc_id = w.doc_id and s.k = w.k + 1)"""


@query(f"""with recursive {WALK_SQL} select doc_id, cast(win as bigint) as win, min(start) as start, max("end") as "end" from walk group by doc_id, win""")
def llm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(windows.windows(paragraphs(spark, sf_dir), most=1000))


def overlapping_sql(overlap: int) -> str:
    """Windows whose first segment reaches back until the segments before have ``overlap`` characters."""
    return f"""{WALK_SQL},
summed as (select *, sum(n) over (partition by doc_id order by k) as c from segs),
wins as (select doc_id, win, min(k) as first, max(k) as last from walk group by doc_id, win),
reached as (select w.doc_id, w.win, w.last, coalesce(min(p.k), w.first) as first from wins w join summed f on f.doc_id = w.doc_id and f.k = w.first
left join summed p on p.doc_id = w.doc_id and w.win > 0 and p.k < w.first and f.c - f.n - p.c < {overlap} group by w.doc_id, w.win, w.last, w.first),
windows as (select r.doc_id, cast(r.win as bigint) as win, a.start, b."end" from reached r join segs a on a.doc_id = r.doc_id and a.k = r.first join segs b on b.doc_id = r.doc_id and b.k = r.last)"""


@query(f'with recursive {overlapping_sql(200)} select doc_id, win, start, "end" from windows')
def llm_windows_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(windows.windows(paragraphs(spark, sf_dir), most=1000, overlap=200))


@query(f"""with recursive {overlapping_sql(100)},
cut as (select w.*, substring(p.text, w.start + 1, w."end" - w.start) as body from windows w join ({PARAGRAPHS_SQL}) p using (doc_id)),
named as (select *, regexp_extract(body, '[a-z]{{8,}}') as word from cut),
found as (select distinct doc_id, start + n as start, start + n + length(word) as "end" from (select *, unnest(list_transform(range(1, len(parts)), lambda i: cast(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(word) as bigint))) as n from (select *, string_split(body, word) as parts from named where word <> '')))
select doc_id, start, "end", 'Person' as label, 'exact' as how from found f
where not exists (select 1 from found g where g.doc_id = f.doc_id and g.start <= f.start and f."end" <= g."end" and (g.start < f.start or f."end" < g."end"))""")
def llm_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in detector called on every window: the first long word."""
    import re

    def call(text: str) -> list[tuple[str, str, str | None]]:
        word = re.search("[a-z]{8,}", text)
        return [("Person", word.group(), "long")] if word else [("Person", "nobody here", None)]

    found, _ = windows.detect(paragraphs(spark, sf_dir), call, most=1000, overlap=100, throttle=0)
    return longs(found.select("doc_id", "start", "end", "label", "how"))


@query("""with recursive turns as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn, text) as k from conversations where text is not null),
walk as (select conv_id, k, turn, text, 0 as batch, length(text) as held from turns where k = 1
union all select t.conv_id, t.k, t.turn, t.text, case when w.held + length(t.text) <= 2000 then w.batch else w.batch + 1 end, case when w.held + length(t.text) <= 2000 then w.held + length(t.text) else length(t.text) end from walk w join turns t on t.conv_id = w.conv_id and t.k = w.k + 1)
select conv_id, turn, cast(batch as bigint) as batch, text from walk""")
def char_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations in batches of at most 2,000 characters."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), "text").where("text is not null")
    return longs(windows.batches(turns, key="conv_id", most=2000).select("conv_id", F.col("ord").alias("turn"), "batch", "text"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents as plain text, Markdown or tables, by id."""
    kinds = F.element_at(F.array(*map(F.lit, ("txt", "md", "pdf", "xlsx"))), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    own = chunking.chunks(documents(spark, sf_dir).withColumn("file_type", kinds))
    return own.select("doc_id", "chunk_index", "chunk")


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element texts of all pages, as the HTML loader gives them."""
    import pyarrow as pa

    from kasumi.sources.loaders import parse_html

    def parsed(batches):
        for batch in batches:
            texts = [parse_html((x or "").encode())[0][1] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(parsed, "page_id long, text string")


# --- store -----------------------------------------------------------------------------------------


@query("select doc_id, sha256(array_to_string(string_split(text, chr(10)), chr(0)) || chr(0)) as content_hash from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.content_hash(F.split("text", "\n")).alias("content_hash"))


HELD_SQL = """held as (select cast(doc_id as varchar) as content_hash, source as source_name, n_chars as char_count, cast(doc_id % 50 as varchar) as created_at from documents),
ner as (select cast(doc_id as varchar) as content_hash, 'm' || (doc_id % 3) as model from labels union all select cast(doc_id as varchar), 'base' from labels where quality = 1),
llm as (select cast(doc_id as varchar) as content_hash, 'v' || (doc_id % 2) as detector_version from labels where toxic = 1)"""


def held(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    own = docs.select(F.col("doc_id").cast("string").alias("content_hash"), F.col("source").alias("source_name"), F.col("n_chars").alias("char_count"), F.pmod("doc_id", F.lit(50)).cast("string").alias("created_at"), F.array().cast("array<string>").alias("chunks"))
    key = F.col("doc_id").cast("string").alias("content_hash")
    ner = labels.select(key, F.concat(F.lit("m"), F.pmod("doc_id", F.lit(3))).alias("model")).union(labels.where("quality = 1").select(key, F.lit("base")))
    llm = labels.where("toxic = 1").select(key, F.concat(F.lit("v"), F.pmod("doc_id", F.lit(2))).alias("detector_version"))
    return own, ner, llm


@query(f"""with {HELD_SQL} select h.*, coalesce((select string_agg(distinct model, ',' order by model) from ner where ner.content_hash = h.content_hash), '') as models, exists (select 1 from llm where llm.content_hash = h.content_hash) as has_llm from held h""")
def cache_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.catalog(*held(spark, sf_dir))


@query("""select doc_id, quality, 'new' as origin from labels where doc_id % 3 = 0 union all select doc_id, quality, 'old' from labels where doc_id % 3 <> 0""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    old = labels.select("doc_id", "quality", F.lit("old").alias("origin"))
    return store.upserted(old, labels.where("doc_id % 3 = 0").select("doc_id", "quality", F.lit("new").alias("origin")), ["doc_id"])


@query(f"with {HELD_SQL} select h.content_hash, case when not exists (select 1 from llm where llm.content_hash = h.content_hash) then 'none' when exists (select 1 from llm where llm.content_hash = h.content_hash and detector_version = 'v1') then 'current' else 'stale' end as status from held h")
def cache_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, _, llm = held(spark, sf_dir)
    return store.status(own.select("content_hash", F.lit("v1").alias("detector_version")), llm)


@query("select doc_id from (select doc_id from labels where quality = 1 union select doc_id from labels where toxic = 1) where doc_id not in (select doc_id from documents where doc_id % 7 = 0)")
def draft_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return entities.with_draft(labels.where("quality = 1"), labels.where("toxic = 1"), docs.where("doc_id % 7 = 0"), ["doc_id"])


@query("select doc_id, 'added' as change from (select doc_id from labels where toxic = 1 except select doc_id from labels where quality = 1) union all select doc_id, 'removed' from (select doc_id from labels where quality = 1 except select doc_id from labels where toxic = 1)")
def draft_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return entities.draft_of(labels.where("toxic = 1"), labels.where("quality = 1"), ["doc_id"])


@query("select t as type, 'new' as drift from (select distinct event_type as t from events except select distinct role from conversations) union all select t, 'gone' from (select distinct role as t from conversations except select distinct event_type from events)")
def ene_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that a detector has and we don't know, and the other way round."""
    return reports.drift(table(spark, sf_dir, "events").select(F.col("event_type").alias("type")), table(spark, sf_dir, "conversations").select(F.col("role").alias("type")))


# --- reports ---------------------------------------------------------------------------------------


@query(f"""with {CANDIDATES_SQL}, levels as (select *, {DEMOTED_SQL} as level from candidates)
select doc_id, start, "end", surface, category, {cases('level', {c: f'{k + 1} : {c}' for k, c in enumerate(V.CONFIDENCE)})} as label, level in ('{V.SURE}', '{V.STRONG}') as mask from levels where level in ({", ".join(map(quoted, V.SHOWN))})""")
def review_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(reports.review(consensus.demote(resolved(spark, sf_dir))).select("doc_id", "start", "end", "surface", "category", "label", "mask"))


@query(f"""with {CANDIDATES_SQL}, counted as (select r.doc_id, r.start, r."end", r.vote, count(distinct r.channel) as channels from ranked r where r.vote is not null group by all),
tops as (select doc_id, start, "end", count(*) as kinds, max_by(vote, channels * 100 - {cases('vote', RANKS)}) as top from counted group by all)
select c.category, c.confidence, count(*) as candidates, cast(count(*) filter (t.kinds > 1 or t.top <> c.category) as bigint) as split from candidates c join tops t using (doc_id, start, "end") group by all""")
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by category and confidence, and on how many the channels disagree."""
    own = reports.audit(resolved(spark, sf_dir))
    return own.groupBy("category", "confidence").agg(F.count("*").alias("candidates"), F.count(F.when(F.col("split"), 1)).alias("split"))


@query(f"with {CANDIDATES_SQL} select c.label, count(*) as spans, count(distinct c.doc_id) as documents from clustered c group by c.label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(votes(documents(spark, sf_dir)), "label")


def escaped_sql(text: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {quoted(raw)}, {quoted(entity)})"
    return text


@query(f"""with hits as (select doc_id, list({{'s': start, 'e': "end", 'l': label}} order by start, "end" desc, label) as hits from (select distinct doc_id, start, "end", label from ({VOTES_SQL})) group by doc_id),
kept as (select doc_id, unnest(list_reduce(list_transform(hits, lambda h: [h]), lambda kept, h: case when h[1].s >= kept[-1].e then kept || h else kept end)) as h from hits),
parts as (select doc_id, h.s as s, h.e as e, h.l as l, lag(h.e, 1, 0) over (partition by doc_id order by h.s) as before from kept),
marked as (select p.doc_id, max(p.e) as last, string_agg({escaped_sql('substring(d.text, p.before + 1, p.s - p.before)')} || '<mark style="background:' || {cases('upper(p.l)', V.COLOURS, quoted(V.PLAIN_COLOUR))} || '">' || {escaped_sql('substring(d.text, p.s + 1, p.e - p.s)')} || ' <small>' || {escaped_sql('p.l')} || '</small></mark>', '' order by p.s) as body from parts p join documents d using (doc_id) group by p.doc_id)
select d.doc_id, replace(coalesce(m.body, '') || {escaped_sql('substring(d.text, coalesce(m.last, 0) + 1)')}, chr(10), '<br>') as html from documents d left join marked m using (doc_id)""")
def highlight_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return spans.highlighted(docs, votes(docs).select("doc_id", "start", "end", "label"))


@query(f"select label, count(*) as spans from ({VOTES_SQL}) where label in ('PERSON', 'Person') group by label")
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.labelled(votes(documents(spark, sf_dir)), ["PERSON", "Person"]).groupBy("label").agg(F.count("*").alias("spans"))


@query(f'select doc_id, start, "end", label from ({VOTES_SQL})')
def detections_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as stored JSON and back."""
    found = votes(documents(spark, sf_dir)).withColumn("reason", F.lit(None).cast("string")).withColumn("how", F.lit("exact"))
    missing = found.limit(0).select("doc_id", "label", F.lit("x").alias("missing"))
    return longs(reports.detected(reports.detections(found, missing)).select("doc_id", "start", "end", "label"))


@query(f"with {HELD_SQL} select content_hash, true as loaded, content_hash in (select content_hash from ner) as recognised, content_hash in (select content_hash from llm) as detected, false as drafted from held")
def pipeline_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, ner, llm = held(spark, sf_dir)
    return reports.state(own.withColumn("chunk_count", F.lit(1)), ner, llm, ner.limit(0))


def contacts_put_sql(text: str, placeholder: str) -> str:
    """(doc_id, masked): all documents with ``placeholder`` in place of contacts and ``text`` of what is between."""
    return f"""{NUMBERED_SQL},
parts as (select k.doc_id, k.start, k."end", n.placeholder, lag(k."end", 1, 0) over (partition by k.doc_id order by k.start) as before from keyed k join numbered n using (doc_id, entity)),
put as (select p.doc_id, string_agg({text.format('substring(d.text, p.before + 1, p.start - p.before)')} || {placeholder}, '' order by p.start) as body, max(p."end") as last from parts p join documents d using (doc_id) group by p.doc_id),
whole as (select d.doc_id, coalesce(p.body, '') || {text.format('substring(d.text, coalesce(p.last, 0) + 1)')} as masked from documents d left join put p using (doc_id))"""


@query(f"with {contacts_put_sql(escaped_sql('{}'), chr(39) + '<mark>' + chr(39) + ' || p.placeholder || ' + chr(39) + '</mark>' + chr(39))} select doc_id, replace(masked, chr(10), '<br>') as html from whole")
def readable_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = placed_contacts(docs)
    return reports.readable(spans.mask(docs, entities.placed(found)), entities.mapping(found))


@query(f"with {contacts_put_sql('{}', 'p.placeholder')} select doc_id, masked as masked_text from whole")
def expanded_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first occurrence of each contact is chosen, and every other one is found and masked with it. Blank texts, which bodies leave out, stay as they are."""
    docs = documents(spark, sf_dir)
    blank = F.coalesce(F.col("text").rlike(f"\\A{prepare.BLANK}*\\z"), F.lit(True))
    masking = Masking()
    analysis = masking.analyze(chunked(docs.where(~blank)))
    first = analysis.candidates.groupBy("doc_id", "surface").agg(F.min("start").alias("start"))
    masked = masking.apply(analysis, analysis.candidates.join(first, ["doc_id", "surface", "start"], "left_semi")).texts
    return masked.union(docs.where(blank).select("doc_id", F.col("text").alias("masked_text")))


@query(f"""with {CANDIDATES_SQL}, strong as (select doc_id, {ENTITY_SQL} as key_text, category, start, "end" from candidates where confidence = '{V.STRONG}' and category not in ('{V.PLACE}', '{V.OTHER}') and not regexp_matches(surface, '[{V.SEPARATORS}]'))
select doc_id, key_text, arg_min(category, start) as category from strong where key_text <> '' group by doc_id, key_text""")
def promoted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces that are strong once, and so are looked for in their whole document."""
    return consensus.promotable(resolved(spark, sf_dir))


LISTED_SQL = f"""{HITS_SQL},
votes as ({VOTES_SQL} union all select doc_id, h.s, h.e, '{V.DICT}', h.g || '{V.DICT_SUFFIX}', -1 from kept),
marked as (select *, case when start < max("end") over (partition by doc_id order by start, "end", ord, channel, label rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from votes),
clustered as (select *, sum(fresh) over (partition by doc_id order by start, "end", ord, channel, label rows between unbounded preceding and current row) as cluster from marked),
anchors as (select distinct doc_id, cluster, start, "end" from clustered where channel = '{V.DICT}'),
unheld as (select distinct doc_id, cluster, start, "end" from clustered v where channel <> '{V.DICT}' and (doc_id, cluster) in (select (doc_id, cluster) from anchors)
    and not exists (select 1 from anchors a where a.doc_id = v.doc_id and a.cluster = v.cluster and (v.start <= a.start and a."end" <= v."end" or a.start <= v.start and v."end" <= a."end"))),
parted as (select *, sum(fresh) over (partition by doc_id, cluster order by start, "end") as part from (select *, case when start < max("end") over (partition by doc_id, cluster order by start, "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from unheld)),
extents as (select doc_id, cluster, start as s, "end" as e from anchors union select doc_id, cluster, min(start), max("end") from parted group by doc_id, cluster, part
    union select doc_id, cluster, min(start), max("end") from clustered where (doc_id, cluster) not in (select (doc_id, cluster) from anchors) group by doc_id, cluster),
surfaced as (select x.*, substring(d.text, s + 1, e - s) as surface from extents x join documents d using (doc_id)),
judged as (select *, {code_sql('surface')} as code, {nonperson_sql('surface')} as nonperson from surfaced),
ranked as (select j.*, c.channel, c.label, c.start as vs, c."end" as ve, c.ord, {VOTE_SQL} as vote from judged j join clustered c on c.doc_id = j.doc_id and c.cluster = j.cluster and c.start < j.e and j.s < c."end"),
opinions as (select doc_id, s, e, surface, arg_min(case when channel = '{V.DICT}' then regexp_extract(label, '^[^(]*') end, vs * 1000000 + ve) filter (channel = '{V.DICT}') as listed,
    min(case when channel not in ('{V.LLM}', '{V.DICT}') and vote is not null then case when (vote = '{V.PERSON}' and (code or nonperson)) or (vote = '{V.COMPANY}' and code) then {RANKS[V.OTHER]} else {cases('vote', RANKS)} end end) as ner,
    min(case when channel = '{V.LLM}' then {cases('vote', RANKS)} end) as llm, count(distinct channel || label) as votes from ranked group by all)"""


@query(f"""with {LISTED_SQL.removeprefix('with ')}
select doc_id, s as start, e as "end", surface, votes, coalesce(listed, {cases('cast(least(coalesce(ner, 99), coalesce(llm, 99)) as varchar)', {str(k): c for c, k in RANKS.items()})}) as category,
case when listed is not null then '{V.SURE}' else case cast(coalesce(ner, 9) < {RANKS[V.PLACE]} as integer) + cast(coalesce(llm, 9) < {RANKS[V.PLACE]} as integer) when 2 then '{V.STRONG}' when 1 then '{V.MEDIUM}' else '{V.WEAK}' end end as confidence from opinions""")
def anchored_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates where dictionary terms split the clusters that they are in."""
    docs = documents(spark, sf_dir)
    found = dictionary.match(dictionary.tokenized(docs), TERMS)
    listed = found.select("doc_id", "start", "end", F.lit(V.DICT).alias("channel"), F.concat("category", F.lit(V.DICT_SUFFIX)).alias("label"), "category", F.lit(-1).cast("long").alias("ord"))
    return longs(consensus.resolve(votes(docs).union(listed), docs).withColumn("votes", F.size("votes")))


@query(f"""{HITS_SQL}, spans as (select doc_id, h.s as s, h.c as canonical, h.g as category, replace(lower(h.c), ' ', '') as entity, substring(text, h.s + 1, h.e - h.s) as surface from kept join documents using (doc_id)),
firsts as (select doc_id, entity, min(s) as first, min(category) as category, bool_or(canonical = 'the') as own from spans group by doc_id, entity),
named as (select *, case when own then '[T]' else '[' || {cases('category', V.PREFIXES)} || row_number() over (partition by doc_id, category, own order by first) || ']' end as placeholder from firsts),
kinds as (select doc_id, entity, surface, min(s) as s from spans group by all)
select doc_id, placeholder, category, string_agg(surface, '/' order by s) as surfaces from named join kinds using (doc_id, entity) group by doc_id, entity, placeholder, category""")
def custom_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of all dictionary terms, one of which has a mask of its own."""
    docs = documents(spark, sf_dir)
    found = consensus.with_surfaces(dictionary.match(dictionary.tokenized(docs), TERMS), docs)
    chosen = entities.ordered(found.drop("canonical").withColumn("confidence", F.lit(V.SURE)))
    return entities.mapping(chosen, TERMS).select("doc_id", "placeholder", "category", F.array_join("surfaces", "/").alias("surfaces"))


@query(f'select doc_id, start, "end", surface from ({CONTACTS_SQL})')
def original_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts found in flattened and padded bodies, as spans of the original."""
    docs = documents(spark, sf_dir).where(F.contains("text", F.lit("@")))  # which bodies keep
    bodies = Masking(flatten=True).bodies(chunked(docs))
    hits = prepare.original_hits(F.col("hits"), F.col("original_text"), F.col("offset_map"))
    found = prepare.body_hits(bodies, V.EMAIL).select("doc_id", F.explode(hits).alias("hit"))
    return longs(found.select("doc_id", "hit.start", "hit.end", "hit.surface"))
