"""Span operators against plain loops."""

import random

import pytest

from kasumi.operators import spans as S

SEEDS = [1, 2, 3]


def made(spark, seed, n=60):
    rng = random.Random(seed)
    rows = [(d, s, s + rng.randint(1, 8), k) for k in range(n) for d in [rng.randint(0, 3)] for s in [rng.randint(0, 40)]]
    return rows, spark.createDataFrame(rows, "doc_id long, start int, end int, ord long")


@pytest.mark.parametrize("seed", SEEDS)
def test_clusters(spark, seed):
    rows, df = made(spark, seed)
    got = {tuple(r) for r in S.segments(df, ["doc_id"]).collect()}
    expected = set()
    for doc in {r[0] for r in rows}:
        start = end = None
        for _, s, e, _ in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], r[2])):
            if start is None or s >= end:
                if start is not None:
                    expected.add((doc, start, end))
                start, end = s, e
            else:
                end = max(end, e)
        expected.add((doc, start, end))
    assert got == expected


@pytest.mark.parametrize("seed", SEEDS)
def test_greedy_choices(spark, seed):
    rows, df = made(spark, seed)
    left, right = set(), set()
    for doc in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == doc]
        reach = None
        for _, s, e, _ in sorted(own, key=lambda r: (r[1], -r[2])):
            if reach is None or s >= reach:
                left.add((doc, s, e))
                reach = e
        reach = None
        for _, s, e, _ in sorted(own, key=lambda r: (-r[1], -r[2])):
            if reach is None or e <= reach:
                right.add((doc, s, e))
                reach = s
    assert {(r.doc_id, r.start, r.end) for r in S.leftmost_longest(df).collect()} == left
    assert {(r.doc_id, r.start, r.end) for r in S.rightmost(df).collect()} == right


@pytest.mark.parametrize("seed", SEEDS)
def test_outermost_is_the_fold(spark, seed):
    rows, df = made(spark, seed)
    expected = set()
    for doc in {r[0] for r in rows}:
        kept = []
        for _, s, e, k in sorted((r for r in rows if r[0] == doc), key=lambda r: (-(r[2] - r[1]), r[1], r[3])):
            if not any(a <= s and e <= b for a, b, _ in kept):
                kept.append((s, e, k))
        expected |= {(doc, *x) for x in kept}
    assert {tuple(r) for r in S.outermost(df, ["doc_id"]).collect()} == expected


def test_regex_spans_count_code_points(spark):
    docs = spark.createDataFrame([(1, "😀 ab@c.de x é@q.io"), (2, "none"), (3, None), (4, "")], "doc_id long, text string")
    got = [tuple(r) for r in S.regex_spans(docs, r"[a-z]+@[a-z]+\.[a-z]+").orderBy("start").collect()]
    assert got == [(1, 2, 9, "ab@c.de")]


def test_masks_and_highlights(spark):
    docs = spark.createDataFrame([(1, "abcdef<"), (2, "same"), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 2, "[A]"), (1, 1, 3, "[B]"), (1, 4, 5, "[C]")], "doc_id long, start int, end int, placeholder string")
    assert {r.doc_id: r.masked_text for r in S.mask(docs, spans).collect()} == {1: "a[B]d[C]f<", 2: "same", 3: None}
    marked = {r.doc_id: r.html for r in S.highlighted(docs, spans.withColumnRenamed("placeholder", "label")).collect()}
    assert marked[2] == "same"
    assert marked[1].startswith("<mark") and marked[1].endswith("f&lt;") and "[B]" not in marked[1]
