"""Sampling, archives, chunks, models and the pipeline."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kasumi.llm import arc_warc, cdc, cws, mixture_lid, ordinal

WORDS = {"xx": "lorem ipsum dolor sit amet consectetur elit", "yy": "qwz krz vxq zzk wqx kvz xzq", "zz": "ooau iaeo uuai eioa aaou oiea"}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


# --- weighted sampling ----------------------------------------------------------------------------


def weights(text):
    return Counter((text or "").lower().split()) or Counter([""])


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)


def test_edits_and_neighbours(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(rng.randint(0, 120))) for _ in range(120)] + ["", None, "é😀" * 300, "same text", "same text", "x" * 60_000]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, edited double").repartition(5)
    got = {r.doc_id: r for r in cws.fingerprint_edits(df).collect()}
    order = sorted((i, t or "") for i, t in rows)
    errors = []
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        r = got.pop(i)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors.append(r.near_edited - jaccard(weights(text), weights(edited)))
        if after == text:
            assert r.near_next == 1
        errors.append(r.near_next - jaccard(weights(text), weights(after)))
    assert not got
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.08
    same = {r.fingerprint for r in cws.fingerprint_edits(df).where("doc_id in (%s)" % ",".join(str(i) for i, t in rows if t == "same text")).collect()}
    assert len(same) == 1


def test_sampling_of_odd_tables(spark):
    df = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    assert cws.fingerprint_edits(df).first().near_next == 1
    assert cws.fingerprint_edits(df.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "p q"), (5, "a b c d"), (5, "a b c d"), (5, "other"), (None, None)], "doc_id long, text string")
    assert Counter(r.doc_id for r in cws.fingerprint_edits(rows).collect()) == {None: 2, 5: 3}


def test_buckets_never_fall(spark):
    quantiles = [cws.FIRST, cws.FIRST, -5, 0, 10, 10, 10, 10, *range(20, 400), 10_000, 2**63 - 1]
    rows = [(i, h) for i in [-(2**63), -6, -5, 0, 9, 10, 11, 21, 399, 400, 9_999, 10_001, 2**63 - 1] for h in (-(2**63), -(2**62), 0, 2**62, 2**63 - 1)]
    df = spark.createDataFrame([(k, i, h) for k, (i, h) in enumerate(rows)], "k long, i long, h long")
    got = [r.b for r in df.select("k", cws.bucket(F.col("i"), F.col("h"), quantiles).alias("b")).orderBy("k").collect()]
    assert got == sorted(got) and len({b for b, (i, _) in zip(got, rows, strict=True) if i == 10}) == 4


def test_a_hot_id_is_dealt_out(spark, monkeypatch):
    """Rows without an id and of one id go to several buckets; every row still has the next one beside it."""
    monkeypatch.setattr(cws, "BUCKET_CHARS", 200)
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, 7, k]), f"text {rng.randint(0, 10**6)} {k}") for k in range(400)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, bucket int, h int").repartition(3)
    beside = cws.neighbours(df).where("not guest").collect()
    assert len({r.bucket for r in beside if r.doc_id is None}) > 4 and len({r.bucket for r in beside if r.doc_id == 7}) > 4
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    following = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    assert {r.text: r.next_text for r in beside} == following


# --- archives -------------------------------------------------------------------------------------


def test_archives_come_back(spark):
    same = "<p>é</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(7, "http://a/ b", same), (3, None, same), (9, "http://c", same), (4, "http://d", None), (5, "", ""), (6, "http://e", "x" * 50_000), (8, "http://f\n", "u\nnique"), (3, "http://g", "other")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, record int").repartition(3)
    for least in (0, 1):
        got = sorted(tuple(r) for r in arc_warc.archive(df, least_bytes=least).select("page_id", "payload_bytes", "payload_digest", "record_type", F.coalesce("refers_to", F.lit(-1))).collect())
        first = {}
        for i, _, html in rows:
            first[html or ""] = min(first.get(html or "", i), i)
        expected = []
        for i, _, html in rows:
            raw = (html or "").encode()
            copy = first[html or ""] != i and len(raw) >= least
            expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if copy else "response", first[html or ""] if copy else -1))
        assert got == sorted(expected)
    assert arc_warc.archive(df.limit(0)).count() == 0


def test_archives_hold_what_they_say(spark, tmp_path):
    """Every version block becomes a warcinfo, files hold several blocks, equal payloads are kept once; plain gzip reads the files."""
    import gzip

    rows = [(k, f"http://h/{k}", f"<p>{k % 5}</p>" * 200) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # a block for each batch
    arc_warc.write_arc(df, f"{tmp_path}/arc")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    arc_warc.known_records(spark, f"{tmp_path}/arc").write.parquet(f"{tmp_path}/known")
    arc_warc.convert(spark, f"{tmp_path}/arc", arc_warc.revisits(spark.read.parquet(f"{tmp_path}/known")), f"{tmp_path}/warc")
    for kind in ("arc", "warc"):
        files = [p for p in (tmp_path / kind).iterdir() if p.name.startswith("part-") and p.stat().st_size]
        assert len(files) < 5
        data = b"".join(gzip.decompress(p.read_bytes()) for p in files)
        if kind == "arc":
            blocks = [r for r in arc_warc.read_arc(data) if r.fields["URL"].startswith("filedesc://")]
            assert len(blocks) == 6 and len(list(arc_warc.read_arc(data))) == 66
        else:
            found = list(arc_warc.read_warc(data))
            kinds = Counter(r.headers["WARC-Type"] for r in found)
            assert kinds == {"warcinfo": len(blocks), "response": 5, "revisit": 55}
            assert len({r.headers["WARC-Record-ID"] for r in found}) == len(found)


def test_a_batch_of_several_blocks(spark):
    rng = random.Random(3)
    rows = [(k, "http://h", "".join(rng.choice("abc") for _ in range(1_500_000)) + str(k % 7)) for k in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.payload_bytes, r.record_type) for r in arc_warc.archive(df).collect()}
    assert got == {k: (len(html), "response") for k, _, html in rows}


def test_versions_of_arc():
    block = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nbody\nhttp://x 0.0.0.0 2000 text/html 3\nabc"
    raw = b"".join(arc_warc.arc_version_block(v, f"f{v}.arc") + arc_warc.arc_record(v, "http://x/", block, ip="1.2.3.4", date="20010203040506") for v in (1, 2))
    for data in (raw, arc_warc.member(raw)):
        records = list(arc_warc.read_arc(data))
        assert [r.version for r in records] == [1, 1, 2, 2]
        info, page = arc_warc.to_warc(records[0]), arc_warc.to_warc(records[3])
        assert info.headers["WARC-Type"] == "warcinfo" and info.headers["WARC-Filename"] == "f1.arc"
        assert page.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and page.headers["WARC-IP-Address"] == "1.2.3.4"
        assert page.headers["WARC-Payload-Digest"] == "sha1:" + arc_warc.sha1(block.partition(b"\r\n\r\n")[2])
        assert arc_warc.to_warc(records[1]).headers["WARC-Record-ID"] == page.headers["WARC-Record-ID"]
        back = list(arc_warc.read_warc(bytes(page) + bytes(arc_warc.to_revisit(page, "<urn:x>"))))
        assert back[0].block == block and back[1].headers["WARC-Refers-To"] == "<urn:x>" and back[1].block == block.partition(b"body")[0]
    plain = arc_warc.ArcRecord(1, {"URL": "dns:x", "IP-address": "0.0.0.0", "Archive-date": "2000", "Content-type": "text/dns", "Archive-length": "1"}, b"x")
    assert arc_warc.to_warc(plain).headers["WARC-Type"] == "resource"


@pytest.mark.parametrize("raw", [b"http://x 1 2 3 4", b"filedesc://x 0 0 t 9\n1 0 x\n", b"filedesc://x 0 0 t 4\n9 0\n\n", b"http://x a b c d\n"])
def test_broken_archives_raise(raw):
    with pytest.raises(arc_warc.ArcError):
        list(arc_warc.read_arc(raw))


# --- chunks ---------------------------------------------------------------------------------------


def test_borders_shift_with_the_text():
    rng = random.Random(1)
    body = " ".join(f"{rng.randint(0, 10**9)}" for _ in range(400))

    def cuts(text):
        starts = cdc.borders([text.encode()])[0][0]
        return {text.encode()[a:b] for a, b in zip(starts, starts[1:], strict=False)}

    assert len(cuts(body) & cuts("inserted words " + body)) > 0.95 * len(cuts(body))
    for text in ("", " ", "one", "x " * 1000, body, "\n\n a"):
        starts, words = cdc.borders([text.encode(), b"other one here", text.encode()])[0]
        again = cdc.borders([b"before", text.encode()])[1]
        assert starts.tolist() == again[0].tolist() and words.tolist() == again[1].tolist()
        assert b"".join(text.encode()[a:b] for a, b in zip(starts, starts[1:], strict=False)) == text.encode()
        assert words.sum() == 2 * len(text.split()) and (len(words) == 0 or words.max() <= 2 * cdc.LONGEST)


def test_repeated_passages_go(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 8))) for _ in range(n))
    passages = [fresh(52) for _ in range(30)]
    line = fresh(10)
    rows = []
    for k, passage in enumerate(passages):
        for copy in range(3):
            rows.append((10 * k + copy, f"{line}\n{fresh(40)} {passage} {fresh(30)}"))
    rows += [(5000, rows[0][1]), (5001, None), (5002, ""), (None, rows[1][1]), (6000, fresh(200)), (6000, fresh(100))]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string").repartition(4)
    found = cdc.deduplicate(df).collect()
    got = {r.doc_id: r for r in found if r.doc_id not in (None, 6000)}
    assert len(found) == len(rows) and all(r.digest == "c" for r in found)
    before = {i: t for i, t in rows if i not in (None, 6000)}
    for k, passage in enumerate(passages):
        assert passage in got[10 * k].text and passage not in got[10 * k + 1].text and passage not in got[10 * k + 2].text
        assert line in got[10 * k + 1].text  # a short line stays
        cut = sum(s.length for s in got[10 * k + 1].removed)
        assert 0 < cut <= len(passage) + 1
    for i, r in got.items():
        text = before[i]
        for s in sorted(r.removed or [], key=lambda s: -s.start):
            text = text[: s.start] + text[s.start + s.length :]
        assert text == r.text or (before[i] is None and r.text is None)
    assert len(got[5000].text) < 0.1 * len(before[5000])
    assert {r.text for r in found if r.doc_id == 6000} == {t for i, t in rows if i == 6000}
    assert [r.text for r in found if r.doc_id is None] == [rows[1][1]]
    assert cdc.deduplicate(df.limit(0)).count() == 0
    clash = df.withColumn("removed", F.lit(1)).withColumn("__copies", F.lit(1))
    assert dict(cdc.deduplicate(clash).dtypes)["removed"].startswith("array") and cdc.deduplicate(clash).count() == len(rows)


def plain_dedup(rows, shortest):
    """Chunk by chunk in plain Python, over the operator's borders; whole chunks are compared, not digests."""
    def cut(text):
        own = text.encode()
        starts, worth = cdc.borders([own])[0]
        return [(own[a:b], int(w)) for a, b, w in zip(starts, starts[1:], worth, strict=False)]

    first = {}
    for i, text in rows:
        for own, _ in cut(text or "") if i is not None else ():
            first[own.rstrip()] = min(i, first.get(own.rstrip(), i))
    out = []
    for i, text in rows:
        kept, run, seen, removed, at = [], [], set(), [], 0
        for own, worth in [*cut(text or ""), (None, 0)]:
            key = None if own is None else own.rstrip()
            if key is not None and (key in seen or i is not None and first[key] < i):
                run.append((own, worth))
            else:
                passage = b"".join(x for x, _ in run).decode()
                if sum(w for _, w in run) >= 2 * shortest:
                    removed.append((at, len(passage)))
                else:
                    kept.append(passage)
                at += len(passage)
                run = []
                if own is not None:
                    kept.append(own.decode())
                    at += len(own.decode())
            seen.add(key)
        out.append((i, None if text is None else "".join(kept), removed))
    return out


def test_chunks_equal_plain_python(spark):
    rng = random.Random(11)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))
    shared = [fresh(rng.randint(5, 90)) for _ in range(12)] + ["日本語の文章が続く長い段落であり、" * 4 + "".join(rng.choice("春夏秋冬東西南北") for _ in range(80)), "".join(rng.choice("ABCdef0123+/") for _ in range(700))]
    rows = [(rng.randint(0, 90), " ".join(x for _ in range(rng.randint(0, 6)) for x in (fresh(rng.randint(0, 30)), rng.choice(shared)))) for _ in range(120)]
    rows += [(200, None), (201, ""), (202, "a " * 5000), (203, fresh(20_000)), (None, shared[0] + " " + shared[0] + " " + shared[1]), (204, rows[5][1]), (204, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected = sorted(plain_dedup(rows, cdc.SHORTEST_RUN), key=repr)
    assert sum(bool(r) for _, _, r in expected) > 60
    assert sorted(((r.doc_id, r.text, [(x.start, x.length) for x in r.removed]) for r in cdc.deduplicate(df).collect()), key=repr) == expected


def test_passages_without_spaces_go(spark):
    rng = random.Random(12)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9F00)) for _ in range(n))
    code = lambda n: "".join(rng.choice("ABCDEFghijklmn0123456789+/") for _ in range(n))
    passage, blob = han(200), code(3000)
    rows = [(1, han(90) + passage + han(50)), (2, han(70) + passage + han(80)), (3, "x " + blob), (4, "y z " + code(40) + blob), (5, han(150))]
    got = {r.doc_id: r for r in cdc.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].text for k in (1, 3, 5)] == [t for i, t in rows if i in (1, 3, 5)]
    assert passage[20:-20] not in got[2].text and 150 <= len(got[2].text) <= 190
    assert len(got[4].text) < 200


# --- models ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(1)
    rows = [(k, sentence(rng, lang, rng.randint(3, 120)), lang) for k in range(300) for lang in [rng.choice(list(WORDS))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_and_mixtures(spark, languages):
    rng = random.Random(2)
    model = mixture_lid.learn(languages, usable=~mixture_lid.held_out())
    assert model.languages == ("xx", "yy", "zz")
    own = mixture_lid.predict(languages, model, keep=["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in own]) > 0.99 and all(0 <= r.score <= 1 for r in own)
    mixed = sentence(rng, "xx", 60) + " " + sentence(rng, "yy", 150)
    odd = spark.createDataFrame([(1, mixed), (2, None), (3, ""), (4, "12 34 !!"), (5, "q" * 100_000), (None, "lorem"), (1, mixed)], "doc_id long, text string")
    got = {r.doc_id: r for r in mixture_lid.predict(odd, model, keep=["doc_id"]).collect()}
    assert got[1].languages == ["yy", "xx"] and 0.6 < got[1].score < 0.8
    assert [(got[k].lang_pred, got[k].score) for k in (2, 3, 4)] == [("und", 0.0)] * 3
    assert got[5].lang_pred in model.languages and got[None].lang_pred == "xx"
    assert mixture_lid.predict(odd.limit(0), model, keep=["doc_id"]).count() == 0
    clash = odd.withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    assert dict(mixture_lid.predict(clash, model, keep=["doc_id", "score", "id"]).dtypes)["score"] == "double"
    nothing = mixture_lid.learn(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in mixture_lid.predict(odd, nothing, keep=["doc_id"]).collect()} == {"und"}


def test_a_mixture_is_the_best_of_all_proportions(languages):
    """Held against a grid of proportions, with the same likelihood of windows."""
    rng = random.Random(7)
    model = mixture_lid.learn(languages)
    text = sentence(rng, "xx", 80) + " " + sentence(rng, "zz", 40)
    share = model.mixtures([text])[0]
    buckets, starts = mixture_lid.grams([text])
    logs = np.add.reduceat(model.table[buckets].astype(float), np.arange(0, len(buckets), mixture_lid.WINDOW)) / mixture_lid.TEMPER
    best = max((np.logaddexp(np.log(p) + logs[:, 0], np.log(1 - p) + logs[:, 2]).sum(), p) for p in np.linspace(0.01, 0.99, 99))[1]
    assert share[1] == 0 and abs(share[0] - best) < 0.03
    assert len(starts) == 2


def test_grades(spark):
    rng = random.Random(1)
    vocabulary = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        words = rng.choices(vocabulary, k=rng.randint(20, 200))
        grade = rng.choice([0, 1, 2, 2])
        if grade == 0:
            words.insert(rng.randint(0, len(words)), rng.choice(["vileish", "vileon"]))
        text = " ".join(f"{w}***" if grade == 1 else w for w in words)
        rows.append((k, text))
        labels.append((k, int(grade != 1), int(grade == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame([*labels, (None, 1, 0), (5000, None, None), (1, None, None)], "doc_id long, quality int, toxic int")
    model = ordinal.learn(docs.where("doc_id < 600"), ordinal.grades(rated), levels=3)
    assert model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in ordinal.predict(docs, model, keep=["doc_id"], reach=2).collect()}
    held = [(got[k].tail_probability >= ordinal.KEEP, quality == 1 and toxic == 0) for k, quality, toxic in labels if k >= 600]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "x" * 200_000), (2, "\n"), (3, "日本語 é")], "doc_id long, text string")
    assert len(ordinal.predict(odd, model, keep=["doc_id"], reach=2).collect()) == 5
    assert ordinal.predict(odd.limit(0), model, keep=["doc_id"], reach=2).count() == 0
    nothing = ordinal.learn(docs, ordinal.grades(rated.limit(0)), levels=3)
    assert not nothing.weights.any() and ordinal.predict(odd, nothing, keep=["doc_id"], reach=2).count() == 5


def test_slopes_are_those_of_the_likelihood(monkeypatch):
    """A step in the direction of the weights' slopes raises the likelihood of the grades."""
    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(0, 50, 12)).astype(np.uint32) for _ in range(300)]
    grades = np.array([int((d < 10).sum() > 1) + int((d < 10).sum() > 3) for d in docs])

    def likelihood(model):
        scores = np.array([model.weights[d].sum() for d in docs])
        over = 1 / (1 + np.exp(-(scores[:, None] - model.thresholds)))
        full = np.concatenate([np.ones((len(docs), 1)), over, np.zeros((len(docs), 1))], axis=1)
        return np.log(np.maximum(full[np.arange(len(docs)), grades] - full[np.arange(len(docs)), grades + 1], 1e-12)).sum()

    monkeypatch.setattr(ordinal, "LEAST_STEPS", 0)
    found = [likelihood(ordinal.fit(docs, grades, 3, epochs=n)) for n in (1, 5, 40)]
    assert found == sorted(found) and found[-1] > 0.4 * found[0]


def test_the_fit_is_that_of_the_full_likelihood(monkeypatch):
    """Against a dense model with all features at once, climbed until nothing moves."""
    rng = np.random.default_rng(3)
    n, width = 600, 40
    dense = (rng.random((n, width)) < 0.3).astype(float)
    truth = np.where(np.arange(width) < 8, 1.2, 0) - np.where(np.arange(width) >= 34, 1.0, 0)
    score = dense @ truth + rng.logistic(size=n)
    grades = (score > 1.5).astype(int) + (score > 3.5)
    docs = [np.flatnonzero(x).astype(np.uint32) for x in dense]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def parts(w, t):
        over = sigmoid((dense @ w)[:, None] - t)
        full = np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], axis=1)
        upper, lower = full[np.arange(n), grades], full[np.arange(n), grades + 1]
        return upper, lower, np.maximum(upper - lower, 1e-12)

    w, t = np.zeros(width), np.array([-0.5, 0.5])
    for _ in range(20_000):
        upper, lower, gone = parts(w, t)
        w = w + 0.5 * (dense.T @ ((upper * (1 - upper) - lower * (1 - lower)) / gone) / n - ordinal.RIDGE * w)
        t = t + 0.5 * np.array([(np.where(grades == k, lower * (1 - lower) / gone, 0) - np.where(grades == k + 1, upper * (1 - upper) / gone, 0)).mean() for k in range(2)])
    best = np.log(parts(w, t)[2]).mean()
    model = ordinal.fit(docs, grades, 3)
    mine = np.log(parts(model.weights[:width].astype(float), model.thresholds)[2]).mean()
    assert mine > best - 0.03
    exact, fitted = sigmoid((dense @ w)[:, None] - t), sigmoid((dense @ model.weights[:width])[:, None] - model.thresholds)
    assert np.abs(exact - fitted).mean() < 0.05 and np.mean((exact > 0.5) == (fitted > 0.5)) > 0.95


def test_grades_with_clashing_columns(spark):
    docs = spark.createDataFrame([(k, f"good text number {k}" if k % 2 else "bad *** text", "x", "y") for k in range(60)], "doc_id long, text string, grade string, tail_probability string")
    rated = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    model = ordinal.learn(docs, ordinal.grades(rated), levels=3)
    got = ordinal.predict(docs, model, keep=["doc_id", "grade", "tail_probability"], reach=2)
    assert dict(got.dtypes)["tail_probability"] == "double" and dict(got.dtypes)["grade"] == "string"
    assert all((r.tail_probability >= ordinal.KEEP) == (r.doc_id % 2 == 1) for r in got.collect())


def test_odd_names_of_languages_are_bounded(spark, languages, monkeypatch):
    monkeypatch.setattr(mixture_lid, "MOST_LANGUAGES", 3)
    odd = languages.union(spark.createDataFrame([(1000 + k, "lorem ipsum", f"name {k}") for k in range(30)], languages.schema))
    assert mixture_lid.learn(odd).languages == ("xx", "yy", "zz")


# --- queries and the pipeline ---------------------------------------------------------------------

DIR = "/root/testdata/sf0.001"


def test_every_query_covers_its_table(spark):
    from kasumi.llm.queries import ORACLES, QUERIES

    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").count()
    pages = spark.read.parquet(f"{DIR}/pages.parquet").count()
    for name in ("op2_html", "op6_archive"):
        assert QUERIES[name](spark, DIR).count() == pages
    for name in ("op3_simhash", "op5_sampling", "op7_chunks", "op8_mixture", "op9_bpe", "op10_ordinal"):
        assert QUERIES[name](spark, DIR).count() == docs
    assert QUERIES["op4_best_fit"](spark, DIR).select("doc_id").distinct().count() == docs
    duckdb = pytest.importorskip("duckdb")
    held = duckdb.connect()
    held.execute(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    assert sorted(held.execute(ORACLES["op1_maxscore"]).fetchall()) == sorted(tuple(r) for r in QUERIES["op1_maxscore"](spark, DIR).collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    source = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    rows = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in source]
    passage = " ".join(source[3].text.split()[:55] or ["x"])
    rows += [(90_001, None, "en", "s", 0), (90_002, "12 34", None, "s", 5), (90_003, source[0].text, "en", "s", 1), (90_004, sentence(rng, "xx", 60), None, None, None)]
    rows += [(None, sentence(rng, "xx", 80), "en", "s", 1), (92_000, sentence(rng, "xx", 70), "en", "s", 1), (92_000, sentence(rng, "yy", 70), "en", "s", 1)]
    for k in range(2):
        rows.append((91_000 + k, sentence(rng, "zz", 40) + str(k) + " " + passage, "en", "s", 0))
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if k == 0:
            assert before - after == {90_001, 90_002}
        if k == 2:  # neither a repeated id nor a missing one costs a row
            assert 90_003 not in after or rows[0][0] not in before
            assert docs.where("doc_id = 92000").count() == stayed and (None in before) == (None in after)
        stayed = docs.where("doc_id = 92000").count()
    assert {r.doc_id for r in docs.select("doc_id").collect()} == before
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    (tmp_path / "empty").mkdir()
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.read.parquet(f"{DIR}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/empty/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
