"""Exact top-k by inner product with MaxScore, over shards whose results merge.

Terms are the dimensions; a term's postings are the rows where its component isn't
zero, as a list of rows and components, or as a full column where a quarter of the
rows have one. A term's bound for a query is the most that it can add to a score in
a shard: its weight times the largest component, or the smallest if the weight is
negative, and 0 if a row lacks the term. With a query's terms in order of their
bounds, the last ones whose bounds together stay under its threshold are
non-essential: a row that is in none of the other postings can't be among the best.
Every query has a split of its own. Its essential postings are traversed; what they
bring may still reach the threshold or not; the best of it are scored at once, which
lifts the threshold; then the other terms are probed, ``PROBED`` at a time, for rows
that still compete. Thresholds begin with the k-th best score among a bounded sample
of rows. Ties go to the smaller id.

Vectors come in packed shards and queries in packed blocks, so that the work is a
join of blocks, not of rows. Query blocks, the smaller side, go to all buckets of
shards, and shards to one each. A task holds a block and a shard at a time. Per query
and shard, at most k rows go on to the merge.

On dense vectors in random directions (64 dimensions, 51,282 rows) 42 of 64 terms are
essential for the mean query, and 68 % of the postings are looked at: bounds are far
above real scores there, so little can be passed over. On sparse ones it is under 30 %.

Nulls and edge cases: vectors that are null or hold a null or non-finite component
take no part, neither as rows nor as queries; shorter vectors lack the further
dimensions; empty vectors score 0; very long ones make smaller shards; rows without
an id take no part; repeated ids are rows of their own, a query passes over every row
with its id, and queries of one id are ranked together; an empty table gives no rows;
further columns are ignored, whatever their names. Components whose products could
pass 2**53 are multiplied as Python integers, and scores beyond a long are held at its
ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in a shard, queries in a block, and components in either at most.
SHARD, BLOCK, CELLS = 8_192, 1_024, 1 << 20
#: Rows that first thresholds come from, and terms probed before the rest of the rows is pruned again.
SEEDS, PROBED = 4_096, 4
LONG = np.iinfo(np.int64)


def whole(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): components as floor(scale * x), for the vectors that take part."""
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * F.lit(float(scale))).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    floored = F.transform("x", lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x).cast("double")).otherwise(x))
    return own.where("id is not null and x is not null").where(finite).select("id", floored.alias("v"))


def pack(rows: DataFrame, size: int) -> DataFrame:
    """(block, ids, width, cells, kind): rows gathered to matrices of at most ``size`` rows and ``CELLS`` components, each of one block if rows have that column."""
    keyed = "block" in rows.columns

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        block, widest = None, 0

        def out() -> pa.RecordBatch:
            cells = np.zeros((len(vectors), max(map(len, vectors), default=0)))
            for k, v in enumerate(vectors):
                cells[k, : len(v)] = v
            cells = small(cells)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([cells.shape[1]], pa.int64()), pa.array([cells.tobytes()], pa.binary()), pa.array([cells.dtype.str])], names=["block", "ids", "width", "cells", "kind"])

        for batch in batches:
            flat, sizes = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            stops = np.cumsum(sizes)
            blocks = batch.column(2).to_pylist() if keyed else [None] * len(sizes)
            for k, (i, own) in enumerate(zip(batch.column(0).to_pylist(), blocks, strict=True)):
                if ids and (len(ids) >= size or own != block or (len(ids) + 1) * max(widest, int(sizes[k])) > CELLS):
                    yield out()
                    ids, vectors, widest = [], [], 0
                block, widest = own, max(widest, int(sizes[k]))
                ids.append(i)
                vectors.append(flat[stops[k] - sizes[k] : stops[k]])
        if ids:
            yield out()

    return rows.mapInArrow(packed, "block long, ids binary, width long, cells binary, kind string")


def small(cells: np.ndarray) -> np.ndarray:
    """Whole numbers in two bytes each where they fit."""
    return cells.astype(np.int16) if not cells.size or np.abs(cells).max() < 2**15 else cells


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["cells"], row["kind"]).reshape(len(ids), row["width"])


class Shard:
    """Rows by id, and the postings of every term."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, kind: type):
        order = np.argsort(ids, kind="stable")  # of equal scores the first wins
        self.order, self.ids = order, ids[order]
        self.full: dict[int, np.ndarray] = {}
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.high, self.low = np.zeros(rows.shape[1]), np.zeros(rows.shape[1])
        for t in range(rows.shape[1]):
            column = rows[order, t].astype(kind)
            self.high[t], self.low[t] = column.max(initial=-np.inf), column.min(initial=np.inf)
            there = np.flatnonzero(column)
            if 4 * len(there) >= len(column):
                self.full[t] = column
            else:
                self.lists[t] = there, column[there]
        self.postings = sum(len(x) for x in self.full.values()) + sum(len(x) for x, _ in self.lists.values())

    def probe(self, term: int, rows: np.ndarray) -> np.ndarray:
        """The components of some rows."""
        if term in self.full:
            return self.full[term][rows]
        there, value = self.lists[term]
        if not len(there):
            return np.zeros(len(rows), value.dtype)
        at = np.minimum(np.searchsorted(there, rows), len(there) - 1)
        return np.where(there[at] == rows, value[at], 0)

    def best(self, query: np.ndarray, own: int, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, their scores, postings looked at): the k best of this shard that reach the threshold, rows with the query's id left out."""
        n = len(self.ids)
        bound = np.maximum(np.maximum(query * self.high, query * self.low), 0)
        terms = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)  # what the terms from here on can add
        essential = int(np.argmax(rest < threshold)) if threshold > 0 else len(terms)
        score, looked = np.zeros(n, query.dtype), 0
        touched = np.zeros(n, bool) if threshold > 0 else None
        for t in terms[:essential].tolist():
            if not query[t]:
                continue
            if t in self.full:
                score += query[t] * self.full[t]
                looked += n
                touched = None
            else:
                there, value = self.lists[t]
                score[there] += query[t] * value
                looked += len(there)
                if touched is not None:
                    touched[there] = True
        alive = self.ids != own
        if touched is not None:
            alive &= touched
        rows = np.flatnonzero(alive & (score + rest[essential] >= threshold))
        score = score[rows]
        if len(rows) > 4 * k and essential < len(terms):  # the best so far lift the threshold
            some = np.argpartition(-score, k - 1)[:k]
            whole = score[some].copy()
            for t in terms[essential:].tolist():
                whole += query[t] * self.probe(t, rows[some])
            looked += k * (len(terms) - essential)
            threshold = max(threshold, float(whole.min()))
            kept = score + rest[essential] >= threshold
            rows, score = rows[kept], score[kept]
        for at in range(essential, len(terms), PROBED):
            now = terms[at : at + PROBED].tolist()
            for t in now:
                if query[t]:
                    score = score + query[t] * self.probe(t, rows)
                    looked += len(rows)
            kept = score + rest[at + len(now)] >= threshold
            rows, score = rows[kept], score[kept]
            if not len(rows):
                break
        if len(rows) > k:
            least = -np.partition(-score, k - 1)[k - 1]
            above = score > least
            chosen = above | (score == least) & (np.cumsum(score == least) <= k - above.sum())
            rows, score = rows[chosen], score[chosen]
        return rows, score, looked


def arithmetic(queries: np.ndarray, rows: np.ndarray) -> type:
    """What holds all scores exactly."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, queries.shape[1], rows.shape[1])
    return np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else object


def widened(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (queries, rows))
    return queries, rows


def first_thresholds(queries: np.ndarray, query_ids: np.ndarray, seeds: np.ndarray, seed_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the seeds, minus infinity if there are fewer."""
    if len(seeds) <= k or arithmetic(queries, seeds) is object:
        return np.full(len(queries), -np.inf)
    queries, seeds = widened(queries.astype(np.float64), seeds.astype(np.float64))
    found = np.full(len(queries), -np.inf)
    for at in range(0, len(queries), 256):
        score = np.where(query_ids[at : at + 256, None] == seed_ids[None, :], -np.inf, queries[at : at + 256] @ seeds.T)
        found[at : at + 256] = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    return found


def top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, thresholds: np.ndarray | None = None, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """(query's place, row's place, score) of the k best rows of each query in one shard. ``work`` gets the postings looked at, and all."""
    queries, rows = widened(queries, rows)
    kind = arithmetic(queries, rows)
    thresholds = np.full(len(queries), -np.inf) if thresholds is None else thresholds
    if kind is object:
        return _by_integers(queries, query_ids, rows, ids, k)
    shard, queries = Shard(ids, rows, kind), queries.astype(kind)
    places: list[np.ndarray] = []
    found: list[np.ndarray] = []
    scores: list[np.ndarray] = []
    for q, (query, own, threshold) in enumerate(zip(queries, query_ids.tolist(), thresholds.tolist(), strict=True)):
        near, score, looked = shard.best(query, own, k, threshold)
        places.append(np.full(len(near), q))
        found.append(shard.order[near])
        scores.append(score)
        if work is not None:
            work[0] += looked
            work[1] += shard.postings
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *found]), np.concatenate([np.zeros(0), *scores]).astype(np.int64).tolist()


def _by_integers(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, list]:
    """For components beyond what floating point holds exactly."""
    places, found, scores = [], [], []
    whole = [[int(v) for v in r] for r in rows]
    for q, query in enumerate(queries):
        own = [int(v) for v in query]
        best = sorted((-sum(a * b for a, b in zip(own, r, strict=True)), i, at) for at, (r, i) in enumerate(zip(whole, ids.tolist(), strict=True)) if i != query_ids[q])[:k]
        places += [q] * len(best)
        found += [at for _, _, at in best]
        scores += [min(max(-x, LONG.min), LONG.max) for x, _, _ in best]
    return np.array(places, np.int64), np.array(found, np.int64), scores


def search(vectors: DataFrame, *, query: Column | str, k: int = 20, scale: float = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that ``query`` picks, itself left out."""
    spark = vectors.sparkSession
    rows, queries = whole(vectors, id_col, vector_col, scale), whole(vectors.where(query), id_col, vector_col, scale)
    total, many = rows.count(), queries.count()
    if not many:
        return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    blocks, buckets = -(-many // BLOCK), max(1, min(-(-total // SHARD) * 2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    share = int(min(1.0, SEEDS / total) * (1 << 30))
    sample = pack(rows.where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < share).limit(2 * SEEDS).coalesce(1), SEEDS).drop("block").collect()  # bounded
    seeds = unpack(sample[0].asDict()) if sample else (np.zeros(0, np.int64), np.zeros((0, 0), np.int16))

    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("long")).repartition("block").sortWithinPartitions("block")
    named = [F.col(c).alias(f"q_{c}") for c in ("ids", "width", "cells", "kind", "thresholds")]

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for row in batch.to_pylist():
                ids, cells = unpack(row)
                lines.append(first_thresholds(cells, ids, seeds[1], seeds[0], k).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lines, pa.binary())], names=[*batch.schema.names, "thresholds"])

    asked = pack(queries, BLOCK).mapInArrow(begun, "block long, ids binary, width long, cells binary, kind string, thresholds binary").select(*named)
    asked = asked.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    shards = pack(rows, SHARD).drop("block").withColumn("bucket", F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(buckets).cast("long")))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = {name: batch.column(name)[k_row].as_py() for name in batch.schema.names}
                query_ids, queries = unpack({c: row[f"q_{c}"] for c in ("ids", "width", "cells", "kind")})
                ids, rows = unpack(row)
                q, r, score = top(queries, query_ids, rows, ids, k, np.frombuffer(row["q_thresholds"], np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(ids[r]), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    found = shards.join(asked, "bucket").mapInArrow(scored, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
