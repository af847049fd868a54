"""Quality of a document by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(s - t_k) with thresholds t_0 < t_1 < ...; the score s is
the sum of one shared weight for every feature a text has. Features are the
hashed words and runs of signs, their hashed beginnings, and levels of a few shares
(capitals, symbols, distinct words and the like), each counted once however often
it occurs. The expected grade is the sum of those probabilities, the tail
probability the one of reaching a given grade.

The fit runs on the driver over a bounded sample of rated rows (``FIT_ROWS``, the
smallest hashes of their ids), of which only features come there; every row is
scored.

Nulls and edge cases: a null text is scored as the empty text; rows without a
rating or an id teach nothing; an id rated twice counts as often; without any
rating all weights are zero; a grade nobody gave has no threshold of its own;
texts of any length are read whole; repeated rows are scored alike; an empty table
gives no rows; columns named like the results are replaced, others pass through as
asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kasumi.llm.common import runs, strings

#: Rated rows to fit on; hash buckets of words; bytes of a word's beginning; levels of each share.
FIT_ROWS, BITS, HEAD, LEVELS = 12_000, 19, 5, 16
EPOCHS, LEAST_STEPS, BATCH, RATE, RIDGE = 20, 1_000, 64, 0.1, 1e-3
#: Probability of the best grade from which a document stays.
KEEP = 0.6
SHARES = 6
WIDTH = (1 << BITS) + SHARES * LEVELS
#: How much a level counts against a word.
LEVEL_WORTH = 20.0
#: 1 in words: small letters, digits and all beyond ASCII; 2 in runs of signs; 0 between.
KIND = np.array([0 if b <= 32 or b == 127 else 1 if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 2 for b in range(256)], dtype=np.int8)
POWERS = np.cumprod(np.full(256, 0x9E3779B1, dtype=np.uint64) | np.uint64(1))


def _mix(key: np.ndarray) -> np.ndarray:
    key = (key ^ key >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return (key ^ key >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct features in turn, and where each text's begin (one more at the end)."""
    raw = [x.encode() + b" " for x in texts]
    lowered = [x.lower().encode() + b" " for x in texts]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lowered])])
    own = np.frombuffer(b"".join(lowered), np.uint8)
    kind = KIND[own]
    inside = kind > 0
    turns = np.concatenate([[True], kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, bool)
    begins = np.nonzero(inside & turns)[0]
    stops = np.nonzero(inside & np.concatenate([turns[1:], [True]]))[0] + 1 if len(kind) else begins
    n = len(texts)
    doc = np.searchsorted(ends, begins, side="right") - 1
    keys = [np.zeros(0, np.int64)]
    distinct, words = np.zeros(n), np.bincount(doc, minlength=n).astype(float)
    if len(begins):
        place = np.arange(len(own)) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(own)]])))
        term = np.where(inside, (own.astype(np.uint64) + np.uint64(1)) * POWERS[place & 255], np.uint64(0))
        whole = _mix(np.add.reduceat(term, begins))
        head = _mix(np.add.reduceat(np.where(place < HEAD, term, np.uint64(0)), begins) + np.uint64(0x51ED270B))
        base = doc.astype(np.int64) * (1 << BITS)
        seen = np.unique(np.stack([doc.astype(np.uint64) << np.uint64(40) | whole >> np.uint64(24)]))
        distinct = np.bincount((seen >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)
        shift = np.uint64(64 - BITS)
        keys += [base + (whole >> shift).astype(np.int64), base + (head >> shift).astype(np.int64)]
    found = np.unique(np.concatenate(keys))
    docs, buckets = found >> BITS, found & ((1 << BITS) - 1)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    size = np.diff(ends).astype(float)

    def share(marked: np.ndarray, at: np.ndarray = ends) -> np.ndarray:
        return np.add.reduceat(marked.astype(float), at[:-1]) / size

    upper = np.frombuffer(b"".join(raw), np.uint8)
    capitals = share((upper >= 65) & (upper <= 90), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    length = np.bincount(doc, weights=(stops - begins).astype(float), minlength=n) / np.maximum(words, 1)
    shares = np.stack([capitals, 3 * share(kind == 2), 10 * share(own == 124), 3 * share((own >= 48) & (own <= 57)), distinct / np.maximum(words, 1), length / 20])
    level = np.minimum(LEVELS - 1, (np.sqrt(np.clip(shares, 0, 1)) * LEVELS).astype(np.int64))
    level = (1 << BITS) + np.arange(SHARES)[:, None] * LEVELS + level
    docs = np.concatenate([docs, np.tile(np.arange(n), SHARES)])
    order = np.argsort(docs, kind="stable")
    return np.concatenate([buckets, level.ravel()])[order].astype(np.uint32), np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=n))])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def worth(buckets: np.ndarray) -> np.ndarray:
    return np.where(buckets >= 1 << BITS, LEVEL_WORTH, 1.0)


@dataclass(frozen=True)
class Ordinal:
    """A weight for each feature and the thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(buckets):
            return np.zeros(len(starts) - 1)
        return np.add.reduceat(self.weights[buckets] * worth(buckets), starts[:-1])

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade > k) for every text and threshold."""
        return _sigmoid(self.scores(*features(texts))[:, None] - self.thresholds[None, :])


def fit(docs: list[np.ndarray], grades: np.ndarray, levels: int, *, epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE, seed: int = 0) -> Ordinal:
    """By likelihood, with steps scaled by the gradients so far; thresholds stay in order. Few documents are gone over more often, for ``LEAST_STEPS`` in all."""
    epochs = max(epochs, LEAST_STEPS * BATCH // max(1, len(docs)))
    rng = np.random.default_rng(seed)
    weights, squares = np.zeros(WIDTH), np.full(WIDTH, 1e-2)
    thresholds = np.linspace(-1, 1, levels - 1) if levels > 2 else np.zeros(levels - 1)
    for epoch in range(epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            flat = np.concatenate([docs[k] for k in some])
            sizes = np.array([len(docs[k]) for k in some])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            value = worth(flat)
            score = np.add.reduceat(weights[flat] * value, starts)
            over = _sigmoid(score[:, None] - thresholds[None, :])
            cumulative = np.concatenate([np.ones((len(some), 1)), over, np.zeros((len(some), 1))], axis=1)
            y = grades[some]
            upper, lower = cumulative[np.arange(len(some)), y], cumulative[np.arange(len(some)), y + 1]
            gone = np.maximum(upper - lower, 1e-9)
            # d log P / d score, and the same by each threshold
            pull = (upper * (1 - upper) - lower * (1 - lower)) / gone
            touched, local = np.unique(flat, return_inverse=True)
            slope = np.bincount(local, weights=np.repeat(pull, sizes) * value) / len(some) - ridge * weights[touched]
            squares[touched] += slope**2
            weights[touched] += rate * slope / np.sqrt(squares[touched])
            for k in range(levels - 1):
                move = np.where(y == k, lower * (1 - lower) / gone, 0) - np.where(y == k + 1, upper * (1 - upper) / gone, 0)
                thresholds[k] += rate * move.mean()
            thresholds = np.sort(thresholds)
    return Ordinal(weights.astype(np.float32), thresholds)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the driver's labels: 0 toxic, 1 of low quality, 2 neither; a label null in both says nothing."""
    return labels.where("quality is not null or toxic is not null").select("doc_id", F.expr("case when toxic = 1 then 0 when quality = 0 then 1 else 2 end").alias("grade"))


def learn(docs: DataFrame, ratings: DataFrame, *, levels: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", rows: int = FIT_ROWS, **options) -> Ordinal:
    """A model of the rated documents; a grade is a whole number from 0, below ``levels``.

    The sample is drawn from the ratings, so that its documents need no shuffle.
    """
    known = ratings.select(F.col(id_col).alias("rated"), F.col(grade_col).cast("int").alias("grade")).where("rated is not null and grade is not null").distinct()
    total = known.count()
    picked = known.where(F.pmod(F.xxhash64("rated"), F.lit(1 << 30)) < F.lit(min(1.0, rows / max(1, total)) * (1 << 30))).limit(2 * rows)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picked = own.join(F.broadcast(picked), F.col("id") == F.col("rated")).select("id", "text", "grade").limit(2 * rows)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch, "text")
            for run in runs(texts):
                buckets, starts = features(texts[run])
                own = batch.slice(run.start, run.stop - run.start)
                flat = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(buckets.astype(np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([own.column("id").cast(pa.string()), own.column("grade"), flat], names=["id", "grade", "buckets"])

    found = picked.mapInArrow(made, "id string, grade int, buckets array<int>").toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    docs = [np.asarray(x.values) for x in found.column("buckets").combine_chunks()] if found.num_rows else []
    return fit(docs, found.column("grade").to_numpy().astype(np.int64), levels, **options)


def predict(docs: DataFrame, model: Ordinal, *, keep: list[str], reach: int, text_col: str = "text") -> DataFrame:
    """The kept columns, expected_grade and tail_probability, that of a grade of at least ``reach``; both take the places of columns of those names."""
    keep = [c for c in keep if c not in ("expected_grade", "tail_probability")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH x 4 bytes, whatever the input
    kept = docs.select(*keep).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = strings(batch, "__text")
            tails = np.concatenate([np.zeros((0, len(model.thresholds))), *(model.tails(texts[run]) for run in runs(texts))])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(tails.sum(axis=1)), pa.array(tails[:, reach - 1])], names=[*kept.names, "expected_grade", "tail_probability"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(scored, f"{fields}, expected_grade double, tail_probability double")
