"""Bounded-space online best-fit packing of documents into sequences.

Every task packs the documents of its own partition as they come, batch by batch and
in a batch the longest pieces first, so nothing is shuffled. A packer keeps at most ``open_bins`` bins open: a bitset over the free
space says which sizes have an open bin, and its lowest set bit at or above a
piece's length is the best fit. When all are taken, the fullest bin closes.

Only documents over ``capacity`` are cut: into full pieces, before which the
remainder comes as a shorter first piece, so that only remainders and short
documents need a bin.

Nulls and edge cases: a null or empty text has the end token alone; a null id is
kept as null; repeated ids and repeated rows are packed like any others, each for
itself; texts of any length are taken whole; pieces of equal length keep the order of
their documents; an empty table gives no rows; columns other than the id and the text
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kasumi.llm.common import rows, strings
from kasumi.llm.tokens import byte_bpe

CAPACITY = 1024
OPEN_BINS = 4096
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset"))])


class BestFit:
    """Places lengths into bins: ``place(length)`` gives the bin's number and the offset there."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = self.open = self.bins = 0
        self.by_free: list[deque[int]] = [deque() for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.popleft()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a length of {length} doesn't fit into {self.capacity}")
        if fitting := self.bits >> length:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.bins
            self.bins += 1
        if left := free - length:
            if self.open >= self.open_bins:  # the fullest: the lowest bit
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids; the first is the shorter one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], *, end_id: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, with the sequence and the place there that it goes to.

    ``encoder()`` runs once in each task and gives the function from a text to its ids.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, fit = encoder(), BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch, text_col), strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                found += [(doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())) for k, (start, length) in enumerate(pieces(len(ids), capacity))]
            found.sort(key=lambda row: -row[3])
            placed = [(*row, base + number, offset) for row in found for number, offset in [fit.place(row[3])]]
            yield from rows(ARROW, [[row[k] for row in placed] for k in range(len(ARROW))])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_col).mapInArrow(packed, SCHEMA)


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, *, end_id: int = 2, **options) -> DataFrame:
    """``pack`` with a byte-level BPE vocabulary's files."""

    def encoder() -> Callable[[str], np.ndarray]:
        return byte_bpe(json_path, ranks_path, pattern).encode

    return pack(docs, encoder, end_id=end_id, **options)
