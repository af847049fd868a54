"""Windows, detection and its cache."""

import random

import pytest
from pyspark.sql import functions as F

from kasumi.operators import store as S
from kasumi.operators import windows as W


def loop(text, most, overlap):
    """(start, end) of windows by plain loops."""
    segs, at = [], 0
    for part in text.split("\n\n"):
        if part.strip():
            segs.append((at, at + len(part), len(part)))
        at += len(part) + 2
    groups, held = [], []
    for s in segs:
        if held and sum(x[2] for x in held) + s[2] > most:
            groups.append(held)
            held = []
        held = [*held, s]
    groups += [held] if held else []
    out = []
    for k, g in enumerate(groups):
        first = segs.index(g[0])
        have = 0
        while k and first and have < overlap:
            first -= 1
            have += segs[first][2]
        out.append((segs[first][0], g[-1][1]))
    return out


@pytest.mark.parametrize("overlap", [0, 6])
def test_windows_equal_the_loop(spark, overlap):
    rng = random.Random(overlap)
    texts = ["\n\n".join("x" * rng.choice([0, 1, 3, 5, 9, 14]) or rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(60)] + ["", " ", "\n\n\n\n", "one"]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string")
    got = {}
    for r in W.windows(df, most=12, overlap=overlap).orderBy("doc_id", "win").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert got == {k: w for k, t in enumerate(texts) if (w := loop(t, 12, overlap))}


def test_detection_in_windows(spark):
    calls = []

    def call(text):
        if not calls and "retry" in text:
            calls.append(1)
            raise W.RateLimited(0)
        return [("Person", "Bob", "name"), ("Person", "ghost", None)]

    text = "Bob here\n\nretry Bob\n\nno one"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    spans, missing = W.detect(df, call, most=10, overlap=5, throttle=0, calls_at_once=1)
    assert sorted((r.start, r.end, r.label, r.how) for r in spans.collect()) == [(0, 3, "Person", "exact"), (16, 19, "Person", "exact")]
    assert ("ghost", 1) in [(r.missing, r.doc_id) for r in missing.collect()] and missing.count() == missing.distinct().count()


def test_retries_wait_longer_each_time():
    waits, left = [], [3]

    def call():
        left[0] -= 1
        if left[0] >= 0:
            raise W.RateLimited(7 if left[0] == 1 else None)
        return ["ok"]

    assert W.with_retries(call, retries=3, base=2, sleep=waits.append) == ["ok"]
    assert waits == [2, 7, 8]
    with pytest.raises(W.RateLimited):
        W.with_retries(lambda: (_ for _ in ()).throw(W.RateLimited()), retries=1, sleep=waits.append)


def test_batches(spark):
    rows = [(1, k, "x" * n) for k, n in enumerate([5, 4, 20, 1, 1, 9])]
    got = {r.ord: r.batch for r in W.batches(spark.createDataFrame(rows, "doc_id long, ord int, text string"), most=10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 3}


def test_version_names():
    assert W.detector_version("v", most=10, overlap=1, target="pii") == "v|win10ov1|tgtpii"
    assert W.detector_version("v", target="x").endswith("|tgtall")


def llm(spark, *rows):
    return spark.createDataFrame([(h, "m", False, v, d, "2026") for h, v, d in rows], S.SCHEMAS["llm_detection"])


def test_store(spark, tmp_path):
    held = S.Store(spark, str(tmp_path))
    assert held.read("ner").count() == 0 and held.catalog().count() == 0
    held.put("llm_detection", llm(spark, ("a", "v1", "old"), ("b", "v1", "b")))
    held.put("llm_detection", llm(spark, ("a", "v1", "new"), ("a", "v2", "x")))
    assert sorted((r.content_hash, r.detector_version, r.detections) for r in held.read("llm_detection").collect()) == [("a", "v1", "new"), ("a", "v2", "x"), ("b", "v1", "b")]
    assert [r.detector_version for r in held.versions("a").collect()] == ["v1", "v2"]
    assert held.get("llm_detection", content_hash="a", detector_version="v2").first().detections == "x"
    docs = spark.createDataFrame([("a", "text", "n", 1, 1, "1", ["x"]), ("b", "file", "m", 1, 1, "2", ["y"])], S.SCHEMAS["documents"])
    held.put("documents", docs)
    held.put("ner", spark.createDataFrame([("a", "m2", True, "{}", ""), ("a", "m1", False, "{}", ""), ("a", "m1", True, "{}", "")], S.SCHEMAS["ner"]))
    assert [(r.content_hash, r.models, r.has_llm) for r in held.catalog().collect()] == [("b", "", True), ("a", "m1,m2", True)]
    assert [r.model for r in held.models("a").collect()] == ["m1", "m2"]
    held.set_source_kind("a", "kb")
    assert held.get("documents", content_hash="a").first().source_kind == "kb"
    held.delete("a")
    assert all(held.get(t, content_hash="a").count() == 0 for t in S.SCHEMAS) and held.read("documents").count() == 1
    # nor in any file
    left = b"".join(p.read_bytes() for p in tmp_path.rglob("*.parquet"))
    assert b"text" not in left and b"file" in left
    assert all(len(list((tmp_path / t).glob("v*"))) <= 1 for t in S.SCHEMAS)
    statuses = S.status(spark.createDataFrame([("b", "v1"), ("b2", "v1")], "content_hash string, detector_version string"), held.read("llm_detection"))
    assert sorted(tuple(r) for r in statuses.collect()) == [("b", "current"), ("b2", "none")]


def test_cached_results_are_computed_once(spark, tmp_path):
    held, seen = S.Store(spark, str(tmp_path)), []

    def compute(missing):
        seen.append(sorted(r.content_hash for r in missing.collect()))
        return missing.select("*", F.lit(str(len(seen))).alias("detections"), F.lit("now").alias("created_at"))

    wanted = llm(spark, ("a", "v1", ""), ("b", "v1", "")).drop("detections", "created_at")
    for force in (False, False, True):
        found = held.cached(wanted, "llm_detection", compute, force=force)
    assert seen == [["a", "b"], ["a", "b"]] and {r.detections for r in found.collect()} == {"2"}
    assert held.cached(wanted.withColumn("detector_version", F.lit("v2")), "llm_detection", compute).count() == 2
