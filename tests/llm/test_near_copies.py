"""Near copies against brute force over the shingle sets."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kasumi.llm import simhash


def sets(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edits(rng):
    """Texts with a copy that is appended to, cut off, replaced in one block or changed here and there, and one that shares half."""
    fresh = lambda n: [f"w{rng.randint(0, 50_000)}" for _ in range(n)]
    rows = []
    for group in range(48):
        words, kind = fresh(rng.randint(150, 400)), group % 4
        share = rng.uniform(0.05, 0.18)
        n = int(share * len(words))
        if kind == 0:
            copy = words + fresh(n)
        elif kind == 1:
            copy = words[: len(words) - n]
        elif kind == 2:
            n //= 2
            copy = [*words[:60], *fresh(n), *words[60 + n :]]
        else:
            copy = [fresh(1)[0] if rng.random() < share / 12 else w for w in words]
        rows += [(10 * group, " ".join(words)), (10 * group + 1, " ".join(copy))]
        rows.append((10 * group + 2, " ".join([*words[: len(words) // 2], *fresh(len(words) // 2)])))
    return rows


def components(rows, similarity):
    label = {i: i for i, _ in rows}
    held = [(i, sets(t)) for i, t in rows]
    for k, (i, a) in enumerate(held):
        for j, b in held[k + 1 :]:
            if jaccard(a, b) >= similarity:
                x, y = sorted((label[i], label[j]))
                label = {n: x if r == y else r for n, r in label.items()}
    return {i for i, r in label.items() if i == r}


def test_block_edits_meet(spark):
    rows = edits(random.Random(4))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    expected = components(rows, 0.8)
    assert 96 <= len(expected) <= 110  # nearly all of the 48 copies are above the bound
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()} == expected


def test_blocks_of_a_group_lose_no_pair(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base, *(f"x{rng.randint(0, 9**9)}" for _ in range(10 + 45 * (k % 2)))])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = components(rows, 0.8)
    monkeypatch.setattr(simhash, "_judged", _small(simhash._judged))
    assert {r.doc_id for r in simhash.keep_first(df, words=5, similarity=0.8).collect()} == expected


def _small(judged):
    def run(docs, met, shards, *rest):
        # the workers have their own module: totals beyond the bound deal every group out
        met = met.withColumn("buckets", F.transform("buckets", lambda b: F.struct(b["bucket"].alias("bucket"), F.lit(2 * simhash.GROUP_SHINGLES).alias("total"))))
        return judged(docs, met, shards, *rest)

    return run


def test_lanes_reach_the_similarity():
    """Nine of ten pairs at 0.8 at least are near in some lane, nearly all are; unlike sets hardly ever."""
    rng = np.random.default_rng(5)
    near = far = 0
    for _ in range(300):
        n = int(rng.integers(40, 600))
        whole = rng.integers(0, 2**64, n, dtype=np.uint64)
        swapped = lambda k: np.unique(np.concatenate([whole[k:], rng.integers(0, 2**64, k, dtype=np.uint64)]))
        own = simhash.weighted(np.unique(whole))
        near += bool((np.bitwise_count(own ^ simhash.weighted(swapped(n // 9))) <= simhash.LANE_RADIUS).any())
        far += int((np.bitwise_count(own ^ simhash.weighted(swapped(n * 8 // 10))) <= simhash.LANE_RADIUS).sum())
    assert near >= 294 and far <= 30


def test_order_and_length_of_a_set_do_not_matter():
    rng = np.random.default_rng(6)
    long = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    assert np.array_equal(simhash.weighted(long), simhash.weighted(long[::-1]))
    assert not simhash.weighted(long[:0]).any() and simhash.weighted(long[:1]).any()


def test_odd_rows(spark):
    """Repeated ids with other texts stay, repeated rows and blank texts are one, long texts are read whole."""
    text = " ".join(f"w{k}" for k in range(50))
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(5, text), (9, text.upper()), (None, text), (None, text), (12, ""), (13, None), (3, "a b"), (4, "a b"), (6, "a c"), (7, "one"), (7, "other text with the same id here"), (7, "one"), (7, "One"), (20, long), (21, long + " " + " ".join(f"u{k}" for k in range(10_000))), (22, " ".join(long.split()[:40_000]))]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id int, text string, lane string, __doc int")
    kept = simhash.keep_first(df, words=5, similarity=0.8)
    assert kept.columns == ["doc_id", "text", "lane"]
    got = sorted(((r.doc_id, (r.text or "")[:5]) for r in kept.collect()), key=repr)
    one = next(t for _, t in got if t.lower() == "one")
    assert got == sorted([(5, "w0 w1"), (None, "w0 w1"), (None, "w0 w1"), (12, ""), (3, "a b"), (6, "a c"), (7, one), (7, "other"), (20, "v0 v1"), (22, "v0 v1")], key=repr)
    assert simhash.keep_first(df.limit(0), words=5, similarity=0.8).count() == 0
