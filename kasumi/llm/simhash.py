"""SimHash near-duplicates: vantage-point trees over fingerprints, shards with overlapping borders.

A fingerprint has 64 bits; two are near if they differ in at most ``radius`` bits.
A vantage-point tree splits fingerprints: at a node, those with a distance of at
most mu from the vantage point go left, the others right. By the triangle
inequality a right one can have a partner on the left only if its distance is at
most mu + radius; those go to both sides. So every near pair meets in some leaf.
The top of a tree is built from a bounded sample and deals the fingerprints into
shards; a shard that is still too large is dealt again by a tree of its own; a task
goes on splitting its shard the same way and compares what is left in blocks. Rows
that no tree parts (a dense cloud) are dealt out by pairs of blocks, which is exact
too. Equal fingerprints are one row, so copies cost nothing, and what leaves a task
is a star for each group that hangs together there, not its pairs.

``near_components`` links documents by one fingerprint of all their shingles, which
finds copies with few bits apart. ``keep_first`` takes a Jaccard similarity of
shingle sets instead. At 0.8 plain SimHash lies 10 of 64 bits apart, where triangle
bounds prune nothing, so its fingerprints weigh the shingles: every document has
``LANES`` of them, each of ``GROUPS`` times 16 bits, and in each group a shingle
weighs u**-2 for a uniform u that depends on group and shingle alone. The few heavy
shingles decide the bits, so sets that share them are near. Of pairs at 0.8 a lane
brings 0.27 within one bit, at 0.25 it brings 0.001; all lanes miss 0.007 at 0.8 and
0.001 at 0.85. What is near in some lane is judged on the whole sets of 64-bit
shingle hashes, and only then linked.

Nulls and edge cases: a null or blank text has no shingles and the fingerprint zero,
and all such texts are copies of each other; texts of any length are read whole; a
text shorter than a shingle is one shingle; ties between equal rows go to the
smallest id, then the smallest hash of the whole row; rows that repeat an id are
nodes of their own for ``keep_first``, so that no text goes for the sake of its id;
rows without an id link nothing and stay; an empty table gives no rows; further
columns pass through ``keep_first`` (but ``__doc`` and ``__row``) and are ignored elsewhere.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasumi.llm.common import shared_path, strings
from kasumi.llm.components import connected

#: Fingerprints the top of a tree is built from; rows a shard should have; rows a task takes at most.
SAMPLE, SHARD_TARGET, SHARD_ROWS = 32_768, 24_000, 100_000
#: Times that shards are dealt again by trees of their own before blocks do the rest.
DEALT_AGAIN = 1
#: Rows that are compared with each other without further splitting.
LEAF = 256
#: Pairs of fingerprints that are compared at once; they bound a task's memory.
PAIRS = 500_000
#: The share of pairs that a split may leave: to deal rows out by it, and to split within a task.
WORTH_DEALING, WORTH_SPLITTING = 0.75, 0.93
SEED = 42

#: Weighted fingerprints of a set, groups of bits in each, shingles that count in a group, bits apart that are near.
LANES, GROUPS, HEAVIEST, LANE_RADIUS = 16, 4, 8, 1
#: Shingles (of 8 bytes) that a task should judge, and that a group may have before it is dealt out by blocks.
SHARD_SHINGLES, GROUP_SHINGLES = 2_000_000, 6_000_000
#: Shingles that are looked up, or sent, at once.
STEP = 1_000_000
_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (3, LANES * GROUPS, 1), dtype=np.uint64)


def shingles(text: str, width: int, repeats: bool = True) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, in runs of ``width`` (fewer words: all in one)."""
    words = text.encode().lower().split()
    if not words:
        return []
    if len(words) <= width:
        found = [b" ".join(words)]
    elif width == 1:
        found = words
    else:
        found = list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    return found if repeats else list(set(found))


def majority(hashes: np.ndarray) -> np.ndarray:
    """Rows of 64-bit lanes as one row: a bit is set if it is in over half of them."""
    n, lanes = hashes.shape
    count = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, n, 4096):
        raw = np.ascontiguousarray(hashes[at : at + 4096].astype(">u8")).view(np.uint8)
        count += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * count > n).view(">u8").astype(np.uint64)


def fingerprint(found: list[bytes]) -> int:
    """A bit is set if it is in over half of the shingles' XXH64; 0 without shingles."""
    if not found:
        return 0
    digest = xxhash.xxh64_digest
    return int(majority(np.frombuffer(b"".join([digest(x, SEED) for x in found]), ">u8")[:, None])[0])


def fingerprints(docs: DataFrame, *, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s0): the fingerprint of every text's shingles, repeats included, as a signed long. A null or blank text has zero."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(shingles(x, width)) for x in strings(batch, text_col)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "s0"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(made, "doc_id long, s0 long")


@dataclass(frozen=True)
class Node:
    """Left: at most ``mu + radius`` from the point; right: over ``mu``. A leaf has a number only."""

    point: int = 0
    mu: int = 0
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1


def distance(prints: np.ndarray, point: int) -> np.ndarray:
    return np.bitwise_count(prints ^ np.uint64(point))


def border(prints: np.ndarray, radius: int, rng: np.random.Generator, most: float = WORTH_DEALING) -> tuple[int, int] | None:
    """The vantage point and mu that split best, or None if more than ``most`` of the pairs would be left."""
    best, found = most * len(prints) ** 2, None
    for point in prints[rng.integers(0, len(prints), 6)]:
        upto = np.cumsum(np.bincount(distance(prints, int(point)), minlength=65 + radius))
        left, right = upto[radius : 65 + radius].astype(float), len(prints) - upto[:65].astype(float)
        cost = left**2 + right**2
        mu = int(cost.argmin())
        if cost[mu] < best:
            best, found = cost[mu], (int(point), mu)
    return found


def build(sample: np.ndarray, radius: int, total: int, target: int) -> tuple[Node, int]:
    """The top of a tree for ``total`` fingerprints, and its number of leaves."""
    rng, leaves = np.random.default_rng(SEED), 0

    def grow(prints: np.ndarray) -> Node:
        nonlocal leaves
        cut = border(prints, radius, rng) if len(prints) >= 32 and len(prints) / max(1, len(sample)) * total > target else None
        if cut is None:
            leaves += 1
            return Node(leaf=leaves - 1)
        far = distance(prints, cut[0])
        return Node(*cut, grow(prints[far <= cut[1] + radius]), grow(prints[far > cut[1]]))

    return grow(sample), leaves


def route(tree: Node, prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows that meet there)."""
    stack = [(tree, np.arange(len(prints)))]
    while stack:
        node, rows = stack.pop()
        if not len(rows):
            continue
        if node.leaf >= 0:
            yield node.leaf, rows
            continue
        far = distance(prints[rows], node.point)
        stack += [(node.left, rows[far <= node.mu + radius]), (node.right, rows[far > node.mu])]


class Forest:
    """Labels of rows under links that come in blocks."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
            self.label = label


def join_local(prints: np.ndarray, radius: int) -> np.ndarray:
    """Labels: the smallest row that each row is near to, directly or through others of these rows."""
    forest, rng = Forest(len(prints)), np.random.default_rng(SEED)

    def compare(rows: np.ndarray) -> None:
        step = max(1, PAIRS // len(rows))
        for at in range(0, len(rows), step):
            some, rest = rows[at : at + step], rows[at:]
            near = np.bitwise_count(prints[some][:, None] ^ prints[rest][None, :]) <= radius
            if np.count_nonzero(near) > 16 * len(rest):  # many links: only those between what is still apart
                near &= forest.label[some][:, None] != forest.label[rest][None, :]
            a, b = np.nonzero(near)
            after = b > a
            a, b = some[a[after]], rest[b[after]]
            apart = forest.label[a] != forest.label[b]
            forest.link(a[apart], b[apart])

    stack = [np.arange(len(prints))]
    while stack:
        rows = stack.pop()
        cut = border(prints[rows], radius, rng, WORTH_SPLITTING) if len(rows) > LEAF else None
        if cut is None:
            if len(rows) > 1:
                compare(rows)
            continue
        far = distance(prints[rows], cut[0])
        stack += [rows[far <= cut[1] + radius], rows[far > cut[1]]]
    return forest.label


DEALT = "lane long, s long, shard long, block long"


def _routed(rows: DataFrame, trees: dict[int, tuple[Node, int]], by: str, radius: int) -> DataFrame:
    """Rows (lane, s, shard, block) with the shards that the tree of their ``by`` sends them to, numbered from the tree's first one."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, prints = batch.column(by).to_numpy(), batch.column("s").to_numpy().view(np.uint64)
            places, shards = [], []
            for own in np.unique(group).tolist():
                mine = np.flatnonzero(group == own)
                tree, first = trees[own]
                for leaf, rows in route(tree, prints[mine], radius):
                    places.append(mine[rows])
                    shards.append(np.full(len(rows), first + leaf))
            if places:
                part = batch.select(["lane", "s"]).take(pa.array(np.concatenate(places)))
                zero = np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(shards)), pa.array(zero)], names=["lane", "s", "shard", "block"])

    return rows.select("lane", "s", "shard", "block").mapInArrow(dealt, DEALT)


def _sampled(rows: DataFrame, by: str, sizes: dict[int, int]) -> DataFrame:
    """About ``SAMPLE`` rows of each, those of the smallest hashes."""
    shares = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, SAMPLE / n))))
    return rows.where(F.pmod(F.xxhash64("s", "lane"), F.lit(1 << 30)) < F.element_at(shares, F.col(by)) * (1 << 30))


def _sizes(rows: DataFrame, by: str) -> dict[int, int]:
    return {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count("*").alias("n")).collect()}  # lanes, or shards: at most as many as samples allow leaves


def near_groups(prints: DataFrame, radius: int) -> DataFrame:
    """(lane, s, root): fingerprints that hang together in some shard; ``root`` is the smallest of them there, itself included.

    ``prints`` has distinct rows (lane, s). Every pair of a lane within ``radius`` bits is in a group together. Fingerprints near no other don't come.
    """
    spark, path = prints.sparkSession, shared_path(prints.sparkSession, "shards")
    sizes = _sizes(prints, "lane")
    if not sizes:
        return spark.createDataFrame([], "lane long, s long, root long")
    own = _sampled(prints, "lane", sizes).select("lane", "s").toArrow()
    lane, s = own.column("lane").to_numpy(), own.column("s").to_numpy().astype(np.int64).view(np.uint64)
    trees, first = {}, 0
    for k, n in sorted(sizes.items()):
        tree, leaves = build(np.sort(s[lane == k]), radius, n, SHARD_TARGET)
        trees[k] = tree, first
        first += leaves
    zero = F.lit(0).cast("long")
    _routed(prints.withColumns({"shard": zero, "block": zero}), trees, "lane", radius).write.parquet(f"{path}/0")
    dealt = spark.read.parquet(f"{path}/0")
    sizes = _sizes(dealt, "shard")
    for again in range(1, DEALT_AGAIN + 1):
        over = {k: n for k, n in sizes.items() if n > SHARD_ROWS}
        if not over:
            break
        # a tree for each of them, made where its sample is
        grown = _sampled(dealt.where(F.col("shard").isin(list(over))), "shard", over).groupBy("shard").applyInArrow(lambda table: _grown(table, over, radius), "shard long, tree binary, leaves long").orderBy("shard").collect()
        trees = {}
        for r in grown:
            trees[r["shard"]] = pickle.loads(r["tree"]), first
            first += r["leaves"]
        kept, large = dealt.where(~F.col("shard").isin(list(over))), dealt.where(F.col("shard").isin(list(over)))
        kept.union(_routed(large, trees, "shard", radius)).write.parquet(f"{path}/{again}")
        dealt = spark.read.parquet(f"{path}/{again}")
        sizes = _sizes(dealt, "shard")
    over = {k: -(-n // (SHARD_ROWS // 2)) for k, n in sizes.items() if n > SHARD_ROWS}
    if over:
        # row in block i of k: to the tasks of all pairs of blocks (i, j)
        blocks = F.create_map(*(F.lit(x) for pair in over.items() for x in pair))
        many = F.coalesce(F.element_at(blocks, F.col("shard")), F.lit(1)).cast("long")
        own = F.pmod(F.xxhash64("s"), many)
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda j: F.least(own, j) * many + F.greatest(own, j))
        dealt = dealt.withColumn("block", F.explode(F.when(many > 1, pairs).otherwise(F.array(F.lit(0).cast("long")))))

    def joined(shard: pa.Table) -> pa.Table:
        prints = np.unique(shard.column("s").to_numpy().astype(np.int64).view(np.uint64))
        label = join_local(prints, radius)
        member = np.bincount(label, minlength=len(label))[label] > 1
        roots = prints[label[member]].view(np.int64)
        return pa.table({"lane": pa.array([shard.column("lane")[0].as_py()] * len(roots), pa.int64()), "s": prints[member].view(np.int64), "root": roots})

    return dealt.groupBy("shard", "block").applyInArrow(lambda table: joined(table), "lane long, s long, root long").distinct()


def _grown(sample: pa.Table, totals: dict[int, int], radius: int) -> pa.Table:
    shard = sample.column("shard")[0].as_py()
    tree, leaves = build(np.sort(sample.column("s").to_numpy().astype(np.int64).view(np.uint64)), radius, totals[shard], SHARD_TARGET)
    return pa.table({"shard": [shard], "tree": pa.array([pickle.dumps(tree)], pa.binary()), "leaves": [leaves]})


def near_components(prints: DataFrame, *, radius: int = 2) -> DataFrame:
    """(doc_id, s0, component_id): the smallest doc_id that links lead to, itself included.

    Rows without a doc_id keep a null component and link nothing; rows that repeat a doc_id are one node, and each comes back; an empty table gives no rows.
    """
    spark, path = prints.sparkSession, shared_path(prints.sparkSession, "fingerprints")
    prints.write.parquet(f"{path}/all")
    prints = spark.read.parquet(f"{path}/all")
    prints.where("doc_id is not null").groupBy("s0").agg(F.min("doc_id").alias("rep")).write.parquet(f"{path}/distinct")
    distinct = spark.read.parquet(f"{path}/distinct")
    groups = near_groups(distinct.select(F.lit(0).cast("long").alias("lane"), F.col("s0").alias("s")), radius)
    links = groups.where("s <> root").select(F.col("s").alias("s0"), "root").join(distinct.select("s0", "rep"), "s0")
    links = links.select("root", F.col("rep").alias("a")).join(distinct.select(F.col("s0").alias("root"), F.col("rep").alias("b")), "root").select("a", "b")
    # rows that repeat an id are one node: the smallest ids of their fingerprints are linked
    repeated = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min("s0").alias("low"), F.max("s0").alias("high")).where("low <> high").select("doc_id")
    links = links.union(prints.join(repeated, "doc_id").select("doc_id", "s0").distinct().join(distinct.select("s0", "rep"), "s0").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = connected(links, "a", "b")
    named = distinct.join(roots, distinct["rep"] == roots["node"], "left").select("s0", F.coalesce("root", "rep").alias("component_id"))
    found = prints.join(named, "s0", "left")
    return found.select("doc_id", "s0", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hexed(lane: str) -> Column:
    """A signed long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(lane), 16, "0"))


# --- near copies by Jaccard similarity ------------------------------------------------------------


def hashed(text: str, words: int) -> np.ndarray:
    """The XXH64 of a text's distinct shingles, in order."""
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(x, SEED) for x in shingles(text, words, False)]), ">u8").astype(np.uint64))


def weighted(own: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of hashes, one for each lane: a bit is set if shingles of over half of its group's weight have it.

    Only the heaviest shingles of a group are summed; the others weigh too little to tell.
    """
    if not len(own):
        return np.zeros(LANES, np.uint64)
    salt, order, turn = _DRAWN
    key = name = np.zeros((LANES * GROUPS, 0), np.uint64)
    for at in range(0, len(own), 4096):
        part = own[None, at : at + 4096]
        key = np.concatenate([key, (part ^ salt) * (order | np.uint64(1))], axis=1)
        name = np.concatenate([name, np.broadcast_to(part, (LANES * GROUPS, part.shape[1]))], axis=1)
        if key.shape[1] > HEAVIEST:
            best = np.argpartition(key, HEAVIEST - 1, axis=1)[:, :HEAVIEST]
            key, name = np.take_along_axis(key, best, axis=1), np.take_along_axis(name, best, axis=1)
    place = np.argsort(key, axis=1)
    key, name = np.take_along_axis(key, place, axis=1), np.take_along_axis(name, place, axis=1)
    u = key.astype(np.float64) + 1
    weight = (u[:, :1] / u) ** 2
    mixed = name + turn
    mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    wide = 64 // GROUPS
    bits = np.unpackbits(np.ascontiguousarray((mixed >> np.uint64(64 - wide)).astype(">u2")).view(np.uint8).reshape(*mixed.shape, wide // 8), axis=2)
    over = 2 * (bits * weight[:, :, None]).sum(axis=1) > weight.sum(axis=1)[:, None]
    return np.packbits(over.reshape(LANES, 64), axis=1).view(">u8").astype(np.uint64)[:, 0]


def shingle_sets(docs: DataFrame, *, words: int, text_col: str) -> DataFrame:
    """(__doc, __row, own, size, lanes) of rows with those first two: what equal sets share, the number of shingles, the weighted fingerprints."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(xxhash.xxh3_128_digest(own.tobytes()), len(own), weighted(own).view(np.int64)) for own in (hashed(x, words) for x in strings(batch, text_col))]
            own, size, wide = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary()), pa.array(size, pa.int64()), pa.array(list(wide), pa.list_(pa.int64()))], names=["__doc", "__row", "own", "size", "lanes"])

    return docs.select("__doc", "__row", text_col).mapInArrow(made, "__doc long, __row long, own binary, size long, lanes array<long>")


def similar(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets have at least that Jaccard similarity with the first; none is empty."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    there = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    common = np.add.reduceat(there.astype(np.int64), np.cumsum(sizes) - sizes)
    return common >= similarity * (len(one) + sizes - common) - 1e-9


def join_group(forest: Forest, nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> None:
    """Links all similar pairs of a group that nothing else links yet."""
    sizes = np.array([len(x) for x in sets])
    for k in range(len(nodes) - 1):
        rest = np.arange(k + 1, len(nodes))
        able = np.minimum(sizes[rest], sizes[k]) >= similarity * np.maximum(sizes[rest], sizes[k]) - 1e-9
        rest = rest[able & (forest.label[nodes[rest]] != forest.label[nodes[k]])]
        step = max(1, STEP // max(1, int(sizes[rest].max(initial=1))))
        for at in range(0, len(rest), step):
            some = rest[at : at + step]
            near = nodes[some[similar(sets[k], [sets[j] for j in some], similarity)]]
            forest.link(np.full(len(near), nodes[k]), near)


def _judged(docs: DataFrame, met: DataFrame, shards: int, words: int, similarity: float, text_col: str) -> DataFrame:
    """(a, b): a spanning forest, in each task, of the similar pairs of sets that meet there."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> pa.RecordBatch:
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "pair", "bucket", "own", "shingles"])

        out, held = [], 0
        for batch in batches:
            for own, buckets, text in zip(*(batch.column(c).to_pylist() for c in ("own", "buckets")), strings(batch, "text"), strict=True):
                raw = hashed(text, words).tobytes()
                for at in buckets:
                    bucket, total = at["bucket"], at["total"]
                    blocks = -(-total // (GROUP_SHINGLES // 2)) if total > GROUP_SHINGLES else 1
                    mine = int.from_bytes(own[:8]) % blocks
                    for other in range(blocks):
                        out.append((bucket % shards if blocks == 1 else -1 - (bucket & (1 << 62) - 1), min(mine, other) * blocks + max(mine, other), bucket, own, raw))
                        held += len(raw) // 8
                        if held > STEP:
                            yield sent()
                            out, held = [], 0
        if out:
            yield sent()

    def joined(shard: pa.Table) -> pa.Table:
        names = shard.column("own").to_pylist()
        known = sorted(set(names))  # so that a label is the smallest
        place = {x: k for k, x in enumerate(known)}
        at = np.array([place[x] for x in names])
        bucket = shard.column("bucket").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in shard.column("shingles").to_pylist()]
        order = np.lexsort((at, bucket))
        forest = Forest(len(known))
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            join_group(forest, at[rows], [sets[k] for k in rows], similarity)
        linked = np.flatnonzero(forest.label != np.arange(len(known)))
        return pa.table({"a": pa.array([known[k] for k in linked], pa.binary()), "b": pa.array([known[forest.label[k]] for k in linked], pa.binary())})

    rows = met.join(docs.select("__doc", "__row", F.col(text_col).alias("text")), ["__doc", "__row"]).select("own", "buckets", "text")
    return rows.mapInArrow(dealt, "shard long, pair long, bucket long, own binary, shingles binary").groupBy("shard", "pair").applyInArrow(lambda table: joined(table), "a binary, b binary")


def near_copies(docs: DataFrame, *, words: int, similarity: float, text_col: str, path: str) -> DataFrame:
    """(__doc, __row, root): the group of each row with an id; equal roots are near copies, directly or through others."""
    spark = docs.sparkSession
    shingle_sets(docs.where("__doc is not null"), words=words, text_col=text_col).write.parquet(f"{path}/all")
    known = spark.read.parquet(f"{path}/all")
    known.groupBy("own").agg(F.min(F.struct("__doc", "__row")).alias("rep"), F.first("size").alias("size"), F.first("lanes").alias("lanes")).select("own", "rep.*", "size", "lanes").write.parquet(f"{path}/sets")
    sets = spark.read.parquet(f"{path}/sets").where("size > 0")
    held = sets.select("own", "__doc", "__row", "size", F.posexplode("lanes").alias("lane", "s")).withColumn("lane", F.col("lane").cast("long"))
    held.groupBy("lane", "s").agg(F.count("*").alias("n")).write.parquet(f"{path}/prints")
    prints = spark.read.parquet(f"{path}/prints")
    # one bucket for each group of near fingerprints, and for each one that several sets have
    near_groups(prints.select("lane", "s"), LANE_RADIUS).union(prints.where("n > 1").select("lane", "s", F.col("s").alias("root"))).distinct().select("lane", "s", F.xxhash64("lane", "root").alias("bucket")).write.parquet(f"{path}/buckets")
    placed = held.join(spark.read.parquet(f"{path}/buckets"), ["lane", "s"]).select("own", "__doc", "__row", "size", "bucket")
    placed.write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1").select("bucket", "total")
    placed.join(shared, "bucket").groupBy("own", "__doc", "__row", "size").agg(F.collect_list(F.struct("bucket", "total")).alias("buckets")).write.parquet(f"{path}/met")
    met = spark.read.parquet(f"{path}/met")
    weight = met.agg(F.sum(F.col("size") * F.size("buckets"))).first()[0] or 0
    links = _judged(docs, met, -(-weight // SHARD_SHINGLES), words, similarity, text_col) if weight else spark.createDataFrame([], "a binary, b binary")
    roots = connected(links, "a", "b")
    return known.select("__doc", "__row", "own").join(roots, F.col("own") == F.col("node"), "left").select("__doc", "__row", F.coalesce("root", "own").alias("root"))


def keep_first(docs: DataFrame, *, words: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, that of the smallest id. Rows without an id stay."""
    docs = docs.drop("__doc", "__row")
    own = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__row": F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))})
    grouped = near_copies(own, words=words, similarity=similarity, text_col=text_col, path=shared_path(docs.sparkSession, "near-copies"))
    first = grouped.groupBy("root").agg(F.min(F.struct("__doc", "__row")).alias("first")).select("first.*")
    kept = own.where("__doc is not null").join(first, ["__doc", "__row"], "left_semi").dropDuplicates(["__doc", "__row"])
    return kept.unionByName(own.where("__doc is null")).select(*docs.columns)
