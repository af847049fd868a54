"""Windows of text for a detector with a limited reach, its calls, and its cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kasumi import values as V
from kasumi.operators.spans import let, outermost, starts_of


def segments(text: Column, length: Callable[[Column], Column] = F.length) -> Column:
    """ARRAY<STRUCT<start, end, n>> of what blank lines part, blank segments left out; ``n`` is its length."""

    def placed(parts: Column) -> Column:
        starts = starts_of(F.transform(parts, lambda part: F.length(part) + len(V.CHUNK_JOINER)))
        own = F.zip_with(parts, starts, lambda part, at: F.struct(at.alias("start"), (at + F.length(part)).alias("end"), length(part).cast("int").alias("n"), part.rlike(r"(?U)\S").alias("solid")))
        return F.transform(F.filter(own, lambda x: x["solid"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["n"].alias("n")))

    return let(F.split(text, V.CHUNK_JOINER), placed)


def packed(segs: Column, most: int = V.WINDOW_TOKENS) -> Column:
    """ARRAY<STRUCT<first, last>>: runs of segments that together have at most ``most``; a longer one is alone."""
    kind = "array<struct<first:int,last:int>>"

    def add(held: Column, i: Column) -> Column:
        n = F.get(segs, i)["n"]
        fits = (held["last"] >= 0) & (held["n"] + n <= most)
        closed = F.when((held["last"] >= 0) & ~fits, F.concat(held["done"], F.array(F.struct(held["first"].alias("first"), held["last"].alias("last"))))).otherwise(held["done"])
        return F.struct(F.when(fits, held["first"]).otherwise(i).alias("first"), i.alias("last"), F.when(fits, held["n"] + n).otherwise(n).alias("n"), closed.alias("done"))

    start = F.struct(F.lit(0).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("n"), F.array().cast(kind).alias("done"))
    places = F.when(F.size(segs) > 0, F.sequence(F.lit(0), F.size(segs) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, add, lambda held: F.when(held["last"] >= 0, F.concat(held["done"], F.array(F.struct(held["first"].alias("first"), held["last"].alias("last"))))).otherwise(held["done"]))


def windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most: int = V.WINDOW_TOKENS, overlap: int = V.WINDOW_OVERLAP, length: Callable[[Column], Column] = F.length) -> DataFrame:
    """(key, win, start, end). With an overlap, a window but the first reaches back over segments until they have that much."""
    own = docs.select(key, segments(F.col(text), length).alias("segs"))
    own = own.select(key, "segs", F.posexplode(packed(F.col("segs"), most)).alias("win", "w"))
    first = F.col("w.first")
    if overlap > 0:
        back = F.reverse(F.slice("segs", F.lit(1), first))
        state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"))
        reached = F.aggregate(back, state, lambda held, s: F.when(held["n"] < overlap, F.struct((held["n"] + s["n"]).alias("n"), (held["k"] + 1).alias("k"))).otherwise(held), lambda held: held["k"])
        first = first - F.when(F.col("win") > 0, reached).otherwise(0)
    return own.select(key, "win", F.get("segs", first)["start"].alias("start"), F.get("segs", F.col("w.last"))["end"].alias("end"))


def batches(docs: DataFrame, *, key: str = "doc_id", text: str = "text", order: str = "ord", most: int = V.BATCH_CHARS) -> DataFrame:
    """The rows of each key numbered by batch: in order, as many as have at most ``most`` characters; a longer one alone.

    Only lengths of a key's rows come together in one row, its texts don't.
    """
    numbered = docs.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(order, text)))
    held = numbered.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__k", F.coalesce(F.length(text), F.lit(0)).alias("n")))).alias("rows"))
    segs = F.transform("rows", lambda r: F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), r["n"].alias("n")))
    runs = held.select(key, F.posexplode(packed(segs, most)).alias("batch", "w"))
    places = runs.select(F.col(key).alias("__key"), "batch", F.explode(F.sequence(F.col("w.first") + 1, F.col("w.last") + 1)).alias("__at"))
    return numbered.join(places, (F.col(key) == F.col("__key")) & (F.col("__k") == F.col("__at"))).select(key, "batch", *(c for c in docs.columns if c != key))


class RateLimited(Exception):
    """What a detector raises to be called again; ``after``: the seconds it asked for."""

    def __init__(self, after: float | None = None):
        super().__init__("rate limited")
        self.after = after


def with_retries(call: Callable[[], Iterable], *, retries: int = 5, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Iterable:
    """The call's result; after a rate limit it waits as asked, or twice as long each time."""
    for attempt in range(retries):
        try:
            return call()
        except RateLimited as error:
            sleep(base * 2**attempt if error.after is None else error.after)
    return call()


#: (window's text) to (type, text, reason); then (window's text, those) to (start, end, type, reason, how) found and (type, text) not found.
Detect = Callable[[str], list[tuple[str, str, str | None]]]
Locate = Callable[[str, list[tuple[str, str, str | None]]], tuple[list[tuple[int, int, str, str | None, str]], list[tuple[str, str]]]]


def locate_literally(text: str, found: list[tuple[str, str, str | None]]) -> tuple[list[tuple[int, int, str, str | None, str]], list[tuple[str, str]]]:
    """All occurrences of each text."""
    spans, missing = [], []
    for kind, part, reason in found:
        at = text.find(part) if part else -1
        if at < 0:
            missing.append((kind, part))
        while at >= 0:
            spans.append((at, at + len(part), kind, reason, "exact"))
            at = text.find(part, at + len(part))
    return spans, missing


DETECTED = "start int, end int, label string, reason string, how string, missing string, win int"


def detect(docs: DataFrame, call: Detect, locate: Locate = locate_literally, *, key: str = "doc_id", text: str = "text", most: int = V.WINDOW_TOKENS, overlap: int = V.WINDOW_OVERLAP, length: Callable[[Column], Column] = F.length, throttle: float = 0.5, retries: int = 5, calls_at_once: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, start, end, label, reason, how) and (key, label, missing): a detector called on each window.

    Spans held by others go, as do repeated misses. ``calls_at_once`` limits the tasks that call.
    """
    cut = windows(docs, key=key, text=text, most=most, overlap=overlap, length=length).join(docs.select(key, F.col(text).alias("__text")), key)
    own = cut.select(key, "win", "start", F.substring("__text", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("window"))
    own = own.repartition(calls_at_once) if calls_at_once else own

    def called(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for doc, win, at, window in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if throttle:
                    time.sleep(throttle)
                spans, missing = locate(window, list(with_retries(lambda window=window: call(window), retries=retries)))
                out += [(doc, s + at, e + at, kind, reason, how, None, win) for s, e, kind, reason, how in spans]
                out += [(doc, None, None, kind, None, None, part, win) for kind, part in missing]
            names = [key, "start", "end", "label", "reason", "how", "missing", "win"]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    kind = docs.schema[key].dataType.simpleString()
    found = own.mapInArrow(called, f"`{key}` {kind}, {DETECTED}")
    spans = outermost(found.where("missing is null"), [key], order="win").select(key, "start", "end", "label", "reason", "how")
    return spans, found.where("missing is not null").select(key, "label", "missing").distinct()


def detector_version(base: str, *, most: int = V.WINDOW_TOKENS, overlap: int = V.WINDOW_OVERLAP, target: str = "all") -> str:
    """A name that changes with the window's policy and the target, so that a cache never mixes them; unknown targets are ``all``."""
    return f"{base}|win{most}ov{overlap}|tgt{target if target in ('all', 'pii') else 'all'}"
