"""Top-k search, HTML and near-duplicates against plain Python."""

import math
import random

import numpy as np
import pytest

from kasumi.llm import html_text, maxscore, simhash
from kasumi.llm.components import connected


def brute(rows, k, scale=64):
    """(query, rank, row, score) of all rows for those whose id 20 divides."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in whole if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(maxscore, "SHARD", 32)
    monkeypatch.setattr(maxscore, "BLOCK", 2)
    monkeypatch.setattr(maxscore, "SEEDS", 60)
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(12)]) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 12), (None, [1.0] * 12), (1060, [0.5] * 5), (1080, []), (1100, [float("inf")])]
    rows += [(1200 + i, [0.0] * k + [rng.gauss(0, 1)] + [0.0] * 30) for i in range(80) for k in [rng.randint(0, 40)]]  # few postings
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, block int").repartition(3)
    got = sorted(tuple(r) for r in maxscore.search(df, query="vec_id % 20 = 0", k=20).collect())
    assert got == brute(rows, 20)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in maxscore.search(df, query="vec_id = 0", k=4).collect())
    # both queries' rows in one ranking: 64*64, 64*64, 64*32, 64*16
    assert got == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 1, 2048), (0, 4, 2, 1024)]


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None])


@pytest.mark.parametrize("sparse", [False, True])
def test_maxscore_passes_postings_over(sparse):
    """Every query splits its own terms; the probes run, and what they skip changes nothing."""
    rng = np.random.default_rng(8)
    rows, queries = unit(rng, 5000, 64), unit(rng, 40, 64)
    if sparse:
        rows, queries = (np.where(rng.random(x.shape) < 0.08, 4 * x, 0) for x in (rows, queries))
    ids, query_ids = np.arange(5000), np.arange(40) + 10_000
    thresholds = maxscore.first_thresholds(queries, query_ids, rows[:1000], ids[:1000], 20)
    work = [0, 0]
    q, r, score = maxscore.top(queries, query_ids, rows, ids, 20, thresholds, work)
    exact = queries @ rows.T
    for k in range(40):
        order = np.lexsort((ids, -exact[k]))[:20]
        own = q == k
        assert sorted(zip((-exact[k][order]).tolist(), order.tolist(), strict=True)) == sorted((-s, i) for s, i in zip(np.array(score)[own].tolist(), r[own].tolist(), strict=True))
    assert work[0] < (0.3 if sparse else 0.75) * work[1]
    shard = maxscore.Shard(ids, rows, np.float64)
    assert bool(shard.lists) == sparse


def test_search_with_large_components_and_few_rows(spark):
    rows = [(0, [2.0**40, 3.0]), (1, [2.0**40, -(2.0**41)]), (20, [1e3, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in maxscore.search(df, query="vec_id % 20 = 0", k=20).collect())
    largest = 2**63 - 1
    assert got == [(q, r, i, max(-(2**63), min(largest, s))) for q, r, i, s in brute(rows, 20)]
    assert maxscore.search(df.where("vec_id < 0"), query="true").count() == 0


PAGES = {
    "<p>one<p>two<ul><li>a<li>b</ul>": "one\n\ntwo\n\n- a\n- b",
    "<ol start=3><li>c<ul><li>x</ul><li value=9>d</ol>": "3. c\n   - x\n9. d",
    "<table><tr><th>Name<th>Q<tr><td>Apple<td>3<tr><td>Banana<td>12</table>": "Name    Q\nApple   3\nBanana  12",
    "<table>loose<tr><td rowspan=2>r<td>1<tr><td>2</table>": "loose\n\nr  1\n   2",
    "<td>a</td>": "a",
    "a<script>x<b></script>b<!-- c --><style>.q{display:none}</style><i class='z q'>d</i>": "ab",
    "<div hidden>x</div><div style='display:none'>y</div><p style='visibility:hidden'>n<b style='visibility:visible'>yes</b>": "yes",
    "<details><summary>s</summary>no</details><dialog>no</dialog><template>no</template><noscript>no</noscript>": "s",
    "a &amp; b &lt;c&gt; &eacute;": "a & b <c> é",
    "<pre>\n  x\n y\n</pre>z": "  x\n y\n\nz",
    "x<br>y": "x\ny",
    "no tags   at\nall": "no tags at all",
    "</p></b>a</div>b": "ab",
    "<a href=\"x": "",
    "1 < 2 <3": "1 < 2 <3",
    "": "",
    "<head><title>t</title></head><body>b": "b",
}


@pytest.mark.parametrize(("html", "text"), PAGES.items())
def test_layout(html, text):
    assert html_text.extract(html) == text


def test_pages_with_nulls_depth_and_length(spark):
    deep, long = "<div>" * 5000 + "x", "<p>w " * 20_000
    rows = [(1, None), (2, deep), (3, long), (3, long), (None, "y")]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = sorted(((r.page_id, r.text) for r in html_text.extract_pages(df).collect()), key=repr)
    assert got == sorted([(1, None), (2, "x"), (3, "\n\n".join(["w"] * 20_000)), (3, "\n\n".join(["w"] * 20_000)), (None, "y")], key=repr)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def plain_components(prints, radius):
    forest = simhash.Forest(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    forest.link(*np.nonzero(np.triu(near, 1)))
    return forest.label


def cloud(seed, n=900):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    flips = lambda x, k: np.bitwise_xor.reduce([x, *(np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64) for _ in range(k))])
    dense = flips(np.repeat(base[:1], n // 2), 4)
    return np.unique(np.concatenate([base, flips(base[: n // 2], 2), flips(base[: n // 3], 3), dense]))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_local_join_finds_all_pairs(radius, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 32)
    prints = cloud(radius)
    assert np.array_equal(simhash.join_local(prints, radius), plain_components(prints, radius))


def test_routed_pairs_meet():
    prints = cloud(7)
    tree, leaves = simhash.build(prints, 2, len(prints), 60)
    assert leaves > 3
    places = [set() for _ in prints]
    for leaf, rows in simhash.route(tree, prints, 2):
        for r in rows:
            places[r].add(leaf)
    a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2, 1))
    assert len(a) and all(places[x] & places[y] for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("most", [200, 100_000])
def test_near_components(spark, monkeypatch, most):
    """Shards beyond the limit are dealt out by pairs of blocks; the result is the same."""
    monkeypatch.setattr(simhash, "SHARD_TARGET", 300)
    monkeypatch.setattr(simhash, "SHARD_ROWS", most)
    prints = cloud(3, 400)
    ids = np.random.default_rng(1).permutation(len(prints))
    rows = [(int(i), int(p)) for i, p in zip(ids, prints.view(np.int64), strict=True)]
    df = spark.createDataFrame([*rows, *[(10_000 + k, rows[k][1]) for k in range(50)], (None, rows[0][1])], "doc_id long, s0 long")
    got = {r.doc_id: r.component_id for r in simhash.near_components(df, radius=2).collect()}
    order = np.argsort(ids)
    label = plain_components(prints[order], 2)
    expected = {int(ids[order[k]]): int(ids[order[label[k]]]) for k in range(len(ids))}
    expected |= {10_000 + k: expected[rows[k][0]] for k in range(50)}
    assert got.pop(None) is None
    assert got == expected


def test_fingerprints_of_texts(spark):
    import xxhash

    def plain(text):
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
        runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    texts = ["A b C d e", "ÀB ÀB", "one", "", "  \t", "x y z\x0bw q", "r " * 500, "Éa b c\x1cd e f"]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = {r.doc_id: r.h for r in simhash.fingerprints(rows, width=3).select("doc_id", simhash.hexed("s0").alias("h")).collect()}
    assert got == {k: f"{plain(t):016x}" for k, t in enumerate(texts)} | {99: "0" * 16}


def test_ids_that_repeat_are_one_node(spark):
    df = spark.createDataFrame([(7, 0), (7, -1), (3, 1), (9, -2), (5, 255 << 20), (5, 255 << 20), (None, 0)], "doc_id long, s0 long")
    got = sorted(((r.doc_id, r.s0, r.component_id) for r in simhash.near_components(df).collect()), key=repr)
    assert got == sorted([(7, 0, 3), (7, -1, 3), (3, 1, 3), (9, -2, 3), (5, 255 << 20, 5), (5, 255 << 20, 5), (None, 0, None)], key=repr)
    assert simhash.near_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [1, 2])
def test_shards_dealt_again_lose_no_pair(spark, monkeypatch, radius):
    """A top of few leaves leaves large shards; trees of their own deal them again."""
    monkeypatch.setattr(simhash, "SAMPLE", 200)
    monkeypatch.setattr(simhash, "SHARD_TARGET", 100)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 150)
    prints = np.concatenate([cloud(3, 400), np.random.default_rng(9).integers(0, 2**64, 1500, dtype=np.uint64)])
    df = spark.createDataFrame([(k, int(p)) for k in (0, 3) for p in np.unique(prints).view(np.int64)], "lane long, s long")
    found = {}
    for r in simhash.near_groups(df, radius).collect():
        found.setdefault((r.lane, r.root), set()).add(np.int64(r.s).view(np.uint64))
    near = lambda a, b: np.bitwise_count(a ^ b) <= radius
    together = {(lane, x, y) for (lane, _), members in found.items() for x in members for y in members}
    own = np.unique(prints)
    a, b = np.nonzero(np.triu(near(own[:, None], own[None, :]), 1))
    assert len(a) > 5 and all((lane, own[x], own[y]) in together for lane in (0, 3) for x, y in zip(a, b, strict=True))


def test_components(spark):
    rng = random.Random(2)
    chain = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 301), (301, 302)]
    rng.shuffle(chain)
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100, 300: 300, 301: 300, 302: 300}
    assert connected(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_fingerprints_with_clashing_columns(spark):
    long = " ".join(f"w{k % 977}" for k in range(100_000))
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (1, "a b c", 5, "x"), (None, long, 6, "y"), (2, None, 7, "z")], "doc_id int, text string, s0 int, component_id string")
    got = simhash.near_components(simhash.fingerprints(df, width=3)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted([(1, 1), (1, 1), (None, None), (2, 2)], key=repr)
