"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document's weighted terms are its lower-case words between white space and how
often they occur. For each of ``SLOTS`` slots and each term, three variables that
depend on the two alone are drawn by hashing: r and c from Gamma(2, 1), beta
uniform. With t = floor(ln w / r + beta), the term with the smallest
ln a = ln c - r * (t - beta + 1) is the slot's sample, and the probability that two
documents have the same sample is their generalised Jaccard similarity
sum(min) / sum(max). As ln a identifies the sample, 16 bits of its hash are kept.

``sampled`` draws for a text and its edited text at once, so that the variables of
a term they share are drawn once. Everything between the one shuffle of the texts
and the signatures happens in that shuffle's partitions: buckets of neighbouring
ids, each with the first document of the next bucket as a guest, so that the next
document is always at hand without a global order in one task. Buckets lie between
quantiles of the ids, at most ``MOST_BUCKETS`` of them; what is known of each bucket,
one row of a few numbers, is ordered in one task and broadcast, so that both are
bounded whatever the input.

Nulls and edge cases: a null text is the empty text, whose one term is the empty
word; so equal texts always have equal fingerprints. Rows without an id come
first. Rows that repeat an id go in order of a hash of their texts, and each comes
back; an id, or the lack of one, that many rows have is dealt to several buckets by
that hash. A lone document is its own next. An empty table gives no rows. Other
columns are ignored, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 32
#: Buckets at most; characters in one (in more, if there were too many) and in a partition.
MOST_BUCKETS, BUCKET_CHARS, PARTITION_CHARS = 65_536, 1_000_000, 5_000_000
#: Quantiles that are looked through one by one, after a tree has led there.
LEAF = 64
#: What stands for a missing id; a row that really has it is ordered like one without.
FIRST = -(1 << 63)


def below(ids: Column, quantiles: list[int], *, equal: bool) -> Column:
    """How many of the ascending quantiles are smaller than an id (or equal to it)."""

    def counted(low: int, high: int) -> Column:
        if high - low <= LEAF:
            line = F.expr("array(" + ", ".join("-9223372036854775808" if x == FIRST else f"{x}L" for x in quantiles[low:high]) + ")").cast("array<bigint>")
            return F.size(F.filter(line, lambda q: q <= ids if equal else q < ids)) + F.lit(low)
        middle = (low + high) // 2
        edge = F.lit(quantiles[middle])
        return F.when(edge <= ids if equal else edge < ids, counted(middle, high)).otherwise(counted(low, middle))

    return counted(0, len(quantiles))


def bucket(ids: Column, hashes: Column, quantiles: list[int]) -> Column:
    """A number that never falls as (id, hash) rises. An id that is several quantiles takes as many buckets, by its hash."""
    low, high = below(ids, quantiles, equal=False), below(ids, quantiles, equal=True)
    span = F.greatest(high - low, F.lit(1))
    part = F.floor((hashes.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * span)
    return (low + F.greatest(F.lit(0), F.least(part, span - 1))).cast("long")


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(bucket, rn, guest, doc_id, text, next_text): every document beside the next; None for an empty table. Partitioned by bucket."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = own.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    if not known["n"]:
        return None
    many = min(MOST_BUCKETS, max(2, -(-known["size"] // BUCKET_CHARS)))
    shares = F.expr("array(" + ", ".join(f"{k / many!r}D" for k in range(1, many)) + ")")
    quantiles = own.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(FIRST)), shares, max(10_000, 4 * many)).alias("q")).first()["q"]
    own = own.withColumns({"h": F.xxhash64("text"), "key": F.coalesce("doc_id", F.lit(FIRST))})
    own = own.withColumn("bucket", bucket(F.col("key"), F.col("h"), quantiles))
    # the first document of each bucket, and the bucket before it that has any (after the last: the first)
    firsts = own.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("first"))
    order = Window.orderBy("bucket")  # a row per bucket, so at most MOST_BUCKETS
    targets = firsts.select(F.col("bucket").alias("t_bucket"), F.col("first.key").alias("t_key"), F.col("first.h").alias("t_h"), F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy())).alias("target"))
    guests = own.join(F.broadcast(targets), (F.col("bucket") == F.col("t_bucket")) & (F.col("key") == F.col("t_key")) & (F.col("h") == F.col("t_h")))
    guests = guests.select("doc_id", "text", "key", "h", F.col("target").alias("bucket"), F.lit(True).alias("guest"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known["size"] // PARTITION_CHARS))
    dealt = own.select("doc_id", "text", "key", "h", "bucket", F.lit(False).alias("guest")).union(guests).repartition(parts, "bucket")
    line = Window.partitionBy("bucket").orderBy("guest", "key", "h", "doc_id")  # with the id, so that both uses have the same columns and share the shuffle
    return dealt.select("bucket", F.row_number().over(line).alias("rn"), "guest", "doc_id", "text", F.coalesce(F.lead("text").over(line), F.lit("")).alias("next_text"))


def edited_text() -> Column:
    """``text`` with its last quarter (rounded down) replaced by as much of ``next_text``'s beginning."""
    return F.expr("concat(left(text, char_length(text) - char_length(text) div 4), left(next_text, cast(char_length(text) div 4 as int)))")


def variables(slot: int) -> tuple[str, str, str]:
    """SQL of r, ln c and beta of ``term`` in a slot, from 64 hashed bits: four times 13 and 12."""
    h = f"xxhash64(term, {slot}L)"
    u = [f"((shiftright({h}, {13 * k}) & 8191) + 0.5D) / 8192" for k in range(4)]
    return f"(-ln({u[0]} * {u[1]}))", f"ln(-ln({u[2]} * {u[3]}))", f"(shiftrightunsigned({h}, 52) / 4096D)"


def smallest(slot: int, weight: str) -> Column:
    """The least ln a of the terms; ``weight`` is the column with ln w, null where the text lacks the term."""
    r, c, beta = variables(slot)
    return F.min(F.expr(f"{c} - {r} * (cast(floor({weight} / {r} + {beta}) as double) - {beta} + 1)"))


def sampled(pairs: DataFrame, keys: list[str], slots: int = SLOTS) -> DataFrame:
    """(keys, fingerprint, edited_fingerprint) of ``text`` and ``edited``; 4 hexadecimal digits a slot."""
    words = pairs.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("x"))
    words = words.select(*keys, F.col("x.side").alias("side"), F.explode(F.split(F.trim(F.regexp_replace(F.lower("x.t"), r"[\x09-\x0D]", " ")), " +")).alias("word"))
    terms = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.sum(1 - F.col("side")).alias("w0"), F.sum("side").alias("w1"))
    terms = terms.select(*keys, "term", F.expr("case when w0 > 0 then ln(cast(w0 as double)) end").alias("l0"), F.expr("case when w1 > 0 then ln(cast(w1 as double)) end").alias("l1"))
    least = terms.groupBy(*keys).agg(*(smallest(k, f"l{side}").alias(f"m{side}_{k}") for k in range(slots) for side in (0, 1)))

    def digits(side: int) -> Column:
        return F.concat(*(F.lower(F.lpad(F.hex(F.xxhash64(f"m{side}_{k}").bitwiseAND(F.lit(65535))), 4, "0")) for k in range(slots)))

    return least.select(*keys, digits(0).alias("fingerprint"), digits(1).alias("edited_fingerprint"))


def likeness(a: str, b: str, slots: int = SLOTS) -> Column:
    """The share of slots with the same sample, an estimate of the generalised Jaccard similarity."""
    same = [F.expr(f"cast(substring({a}, {4 * k + 1}, 4) = substring({b}, {4 * k + 1}, 4) as int)") for k in range(slots)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return total / F.lit(float(slots))


def fingerprint_edits(docs: DataFrame, *, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    beside = neighbours(docs, id_col=id_col, text_col=text_col)
    if beside is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    beside = beside.withColumn("edited", edited_text())
    signed = sampled(beside.select("bucket", "rn", "text", "edited"), ["bucket", "rn"], slots)
    line = Window.partitionBy("bucket").orderBy("rn")
    signed = signed.withColumn("next_fingerprint", F.lead("fingerprint").over(line))
    signed = signed.select("bucket", "rn", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", slots).alias("near_edited"), likeness("fingerprint", "next_fingerprint", slots).alias("near_next"))
    known = beside.where(~F.col("guest")).select("bucket", "rn", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    return known.join(signed, ["bucket", "rn"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
