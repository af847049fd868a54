"""Substring deduplication by content-defined chunks with a gear rolling hash.

A text is cut into units: words between white space; inside words of over
``LONG_WORD`` bytes (encoded data, minified lines) pieces between bytes whose gear
hash has three low zero bits; and single characters of three or more bytes (scripts
without spaces), which count as half a word. The gear hash of the last 16 bytes is
known at every unit's beginning. A chunk begins where that hash is the largest of
its neighbourhood of ``REACH`` units on either side, so a border depends on nearby
text alone: after an insertion the borders are the same again a few words on. Where
hashes are all alike (one word again and again), a chunk ends after ``LONGEST`` units.

A chunk is a duplicate if a document with a smaller id has a chunk of the same
digest, or the same document has one further up. Runs of duplicates with at least
``SHORTEST_RUN`` words are cut out; shorter ones are common phrases and stay.
Digests have 96 bits: among 10**13 chunks two that differ share one with a
probability of 0.0006.

Every text is cut into chunks twice, once to write its digests to the shared folder
and once to take the runs out. Counts of copies are settled per digest: partial
minima come before the shuffle, and the join back splits hot digests. Texts meet
only with the digests of their own duplicates.

Nulls and edge cases: a null text stays null and has no chunks, an empty one stays
empty; a row without an id is freed of repetitions of its own only; rows that
repeat an id count as one document, so none loses its text to the other; texts of
any length are taken whole; of equal texts the smallest id's stays; an empty table
gives no rows; other columns pass through, but ``removed`` is replaced, and
``__copies`` and ``__id`` go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kasumi.llm.common import runs, shared_path, strings

#: Units on either side that a border's hash exceeds; units a chunk has at most; words a run has at least.
REACH, LONGEST, SHORTEST_RUN = 3, 64, 16
#: Bytes from which a word has units inside, and the bits that are zero where one begins.
LONG_WORD, PIECE_MASK = 40, 7
GEAR_BYTES = 16
GEAR = np.random.default_rng(20_240_601).integers(0, 2**32, 256, dtype=np.uint32)
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def gear(own: np.ndarray) -> np.ndarray:
    """At each byte the sum of the gear values of it and the 15 before it, each shifted by its distance."""
    h, width = GEAR[own], 1
    while width < GEAR_BYTES:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, 2 * width
    return h


def units(own: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin among bytes that begin and end with a blank, and half words that each counts for. ``value``: gear hashes."""
    blank = SPACE[own] | (own == 0)
    word = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    stop = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    begins = np.zeros(len(own), bool)
    begins[word] = True
    wide = (own >= 0xE0) & (own != 0xE2)  # E2 begins dashes and quotes
    if wide.any():
        begins |= wide
        begins[1:] |= wide[np.maximum(np.arange(len(own) - 1) - 2, 0)] & (own[1:] < 0x80) & ~blank[1:]  # what follows them in a word
    for k in np.flatnonzero(stop - word > LONG_WORD).tolist():
        inner = slice(int(word[k]) + 1, int(stop[k]))
        begins[inner] |= (value[inner.start - 1 : inner.stop - 1] & PIECE_MASK == 0) & (own[inner] & 0xC0 != 0x80)
    at = np.flatnonzero(begins)
    return at, np.where(wide[at], 1, 2)


def borders(raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, the byte where each chunk begins (one more at the end) and the half words in it."""
    pad = b"\0" * GEAR_BYTES
    own = np.frombuffer(pad + b"".join(x + pad for x in raw), np.uint8)
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    at = GEAR_BYTES + np.concatenate([[0], np.cumsum(sizes + GEAR_BYTES)[:-1]]) if len(raw) else np.zeros(0, np.int64)
    hashes = gear(own)
    unit, worth = units(own, hashes)
    doc = np.searchsorted(at, unit, side="right") - 1
    value = hashes[unit - 1].astype(np.int64) + 1
    # neighbours of other texts count as zero
    spread = np.zeros(len(unit) + (len(raw) + 1) * REACH, dtype=np.int64)
    place = np.arange(len(unit)) + (doc + 1) * REACH
    spread[place] = value
    left, right = np.zeros_like(value), np.zeros_like(value)
    for k in range(1, REACH + 1):
        np.maximum(left, spread[place - k], out=left)
        np.maximum(right, spread[np.minimum(place + k, len(spread) - 1)], out=right)
    cut = (value > left) & (value >= right)
    out = []
    lows = np.searchsorted(doc, np.arange(len(raw) + 1))
    for k, size in enumerate(sizes):
        low, high = lows[k], lows[k + 1]
        if low == high:
            out.append((np.array([0, size]) if size else np.zeros(1, np.int64), np.zeros(1 if size else 0, np.int64)))
            continue
        first = np.nonzero(cut[low:high])[0]
        first = np.unique(np.concatenate([[0], first]))
        gaps = np.diff(np.append(first, high - low))
        if gaps.max() > LONGEST:
            first = np.concatenate([np.arange(f, f + g, LONGEST) for f, g in zip(first, gaps, strict=True)])
        starts = unit[low:high][first] - at[k]
        starts[0] = 0
        out.append((np.append(starts, size), np.add.reduceat(worth[low:high], first)))
    return out


def digests(raw: bytes, starts: np.ndarray) -> list[bytes]:
    """The chunks' digests, 12 bytes each; white space at the end of a chunk doesn't count."""
    ends, digest = starts.tolist(), xxhash.xxh3_128_digest
    return [digest(raw[a:b].rstrip())[:12] for a, b in zip(ends, ends[1:], strict=False)]


def duplicate_runs(own: list[bytes], worth: np.ndarray, elsewhere: set[bytes], shortest: int) -> list[tuple[int, int]]:
    """(from, to) of chunks to cut out: runs of copies with enough words."""
    seen: set[bytes] = set()
    found, begin, held = [], None, 0
    for k, digest in enumerate([*own, None]):
        copied = digest is not None and (digest in elsewhere or digest in seen)
        if copied:
            begin, held = (k, int(worth[k])) if begin is None else (begin, held + int(worth[k]))
        else:
            if begin is not None and held >= 2 * shortest:
                found.append((begin, k))
            begin, held = None, 0
        seen.add(digest)
    return found


def chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(high, low, doc_id): the distinct digests of every document's chunks, as a long and an int."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(strings(batch, "text")):
                part = batch.slice(run.start, run.stop - run.start)
                raw = [x.encode() for x in strings(part, "text")]
                found = [set(digests(x, starts)) for x, (starts, _) in zip(raw, borders(raw), strict=True)]
                wide = np.frombuffer(b"".join(b"".join(x) for x in found), np.dtype([("high", "<i8"), ("low", "<i4")]))
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(wide["high"])), pa.array(np.ascontiguousarray(wide["low"])), pa.array(ids)], names=["high", "low", "doc_id"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.where("doc_id is not null and text is not null").mapInArrow(made, "high long, low int, doc_id long")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest_run: int = SHORTEST_RUN) -> DataFrame:
    """The rows with ``text_col`` freed of copies, and removed: the spans cut out, in code points of the former text. It takes the place of a column of that name."""
    docs = docs.drop("removed", "__copies", "__id")
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "chunks")
    chunks(docs, id_col=id_col, text_col=text_col).write.parquet(path)
    all_chunks = spark.read.parquet(path)
    firsts = all_chunks.groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("last > first").select("high", "low", "first")
    copies = all_chunks.join(firsts, ["high", "low"]).where("doc_id > first").groupBy("doc_id").agg(F.collect_list("high").alias("high"), F.collect_list("low").alias("low"))  # as many as the document has chunks
    copies = copies.select(F.col("doc_id").alias("__id"), F.struct("high", "low").alias("__copies"))
    joined = docs.join(copies, F.col(id_col).cast("long") == F.col("__id"), "left").drop("__id")
    shape = docs.schema

    def known(copies: dict | None) -> set[bytes]:
        if copies is None:
            return set()
        wide = np.empty(len(copies["high"]), np.dtype([("high", "<i8"), ("low", "<i4")]))
        wide["high"], wide["low"] = copies["high"], copies["low"]
        raw = wide.tobytes()
        return {raw[k : k + 12] for k in range(0, len(raw), 12)}

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for run in runs(strings(whole, text_col)):
                batch = whole.slice(run.start, run.stop - run.start)
                texts = batch.column(text_col).to_pylist()
                raw = [(x or "").encode() for x in texts]
                spans: list[list] = []
                for k, (own, (starts, worth), elsewhere) in enumerate(zip(raw, borders(raw), batch.column("__copies").to_pylist(), strict=True)):
                    found = duplicate_runs(digests(own, starts), worth, known(elsewhere), shortest_run)
                    cut = [(int(starts[a]), int(starts[b])) for a, b in found]
                    spans.append([{"start": len(own[:a].decode()), "length": len(own[a:b].decode())} for a, b in cut])
                    if cut:
                        kept, last = [], 0
                        for a, b in cut:
                            kept.append(own[last:a])
                            last = b
                        texts[k] = b"".join([*kept, own[last:]]).decode()
                columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(f.name) for f in shape]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], names=[*shape.names, "removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    return joined.mapInArrow(freed, f"{fields}, removed array<struct<start: bigint, length: bigint>>")
