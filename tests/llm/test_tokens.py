"""Packing and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kasumi.llm import bpe_prefix, packing, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "a" * 30_000, "Hello <|endoftext|> there", "<|startoftext|>it's İΣ ΑΣ 12³ ½", "é ​﻿ 日本語 😀😀", "\x1c\x85\xa0 x\n\n\n  y", "don't WE'LL 'S", "word " * 5000]


def odd_texts(seed, n=300):
    rng = random.Random(seed)
    letters = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), 0x2003, 0x3042, 0x4E00, 0x1F600, 0x301, 0x661]]
    return ["".join(rng.choice(letters if rng.random() < 0.4 else "abcdehinorst' ") for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_both_libraries_agree_below_the_limit():
    own = tokens.ByteBpe(BYTES, RANKS, public_tokenizers.PATTERN)
    whole = Tokenizer.from_file(BYTES)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}", f"{c}a", f" {c}", f"{c} ", f"1{c}1", f"'{c}", c * 3, f"\n{c}\n a"):
            assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_of_odd_texts(seed):
    own, whole = tokens.ByteBpe(BYTES, RANKS, public_tokenizers.PATTERN), Tokenizer.from_file(BYTES)
    words, there = bpe_prefix.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for text in [*odd_texts(seed), *(x for x in ODD if x)]:
        assert own.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
        ids = there.encode(text, add_special_tokens=False).ids
        got = words.encode(text)
        assert memoryview(got).cast("I").tolist() == ids
        assert words.decode(got) == there.decode(ids, skip_special_tokens=False)


def test_every_code_point():
    """In all places of a word, against the library, one by one where a group of them differs."""
    own, there = bpe_prefix.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    shape = lambda c: f"a{c}b {c}1{c}A"
    texts = ["\n".join(map(shape, points[k : k + 64])) for k in range(0, len(points), 64)]
    for k in range(0, len(texts), 500):
        for n, (text, found) in enumerate(zip(texts[k : k + 500], there.encode_batch(texts[k : k + 500], add_special_tokens=False), strict=True)):
            if memoryview(own.encode(text)).cast("I").tolist() != found.ids:
                group = points[64 * (k + n) : 64 * (k + n + 1)]
                wrong = [c for c in group if memoryview(own.encode(shape(c))).cast("I").tolist() != there.encode(shape(c), add_special_tokens=False).ids]
                raise AssertionError([hex(ord(c)) for c in wrong or group])


def test_code_points_of_the_fast_way():
    own, there = bpe_prefix.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for c in [c for c in map(chr, range(0x2100)) if not bpe_prefix.UNCERTAIN.match(c)]:
        for text in (c, f"a{c}", f"{c}a", f" {c}", f"{c} ", f"1{c}1", f"'{c}", c * 3, f"\n{c}\n a", f"{c}S'{c}", f"A{c}\u0301"):
            assert memoryview(own.encode(text)).cast("I").tolist() == there.encode(text, add_special_tokens=False).ids, (c, text)


@pytest.mark.parametrize("path", ["/root/testdata/sf0.01"])
def test_ids_of_whole_documents(path):
    """Every document of the fixture, by both operators' ways."""
    pq = pytest.importorskip("pyarrow.parquet")
    texts = [x or "" for x in pq.read_table(f"{path}/documents.parquet", columns=["text"]).column(0).to_pylist()]
    fast, whole = tokens.ByteBpe(BYTES, RANKS, public_tokenizers.PATTERN), Tokenizer.from_file(BYTES)
    words, there = bpe_prefix.WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for text, a, b in zip(texts, whole.encode_batch(texts, add_special_tokens=False), there.encode_batch(texts, add_special_tokens=False), strict=True):
        assert fast.encode(text).tolist() == a.ids
        assert memoryview(words.encode(text)).cast("I").tolist() == b.ids


def test_a_small_vocabulary_equals_merging_by_rank():
    rng = random.Random(4)
    letters = "abc"
    vocab, merges = {c: k for k, c in enumerate(letters)}, []
    while len(merges) < 40:
        a, b = rng.choice(list(vocab)), rng.choice(list(vocab))
        if a + b not in vocab and len(a + b) < 7:
            vocab[a + b] = len(vocab)
            merges.append((a, b))
    own = bpe_prefix.PrefixBpe(vocab, merges)
    rank = {m: k for k, m in enumerate(merges)}

    def by_rank(word):
        parts = list(word)
        while True:
            found = min(((rank[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
            if found is None:
                return [vocab[p] for p in parts]
            k = found[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for _ in range(3000):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        assert own.encode_word(word) == by_rank(word)
    with pytest.raises(ValueError):
        bpe_prefix.PrefixBpe({"a": 0, "b": 1, "ab": 2, "aba": 3, "ba": 4}, [("a", "b"), ("b", "a"), ("ab", "a"), ("a", "ba")])


def test_encoded_documents(spark):
    rows = [*enumerate(ODD), (3, "again"), (None, "x")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    there = Tokenizer.from_file(WORDS)
    expected = []
    for i, text in rows:
        ids = there.encode(text or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(there.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe_prefix.digests(bpe_prefix.encode_documents(df, WORDS)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert bpe_prefix.encode_documents(df.limit(0), WORDS).count() == 0


def check_packing(rows, got, capacity, ids_of):
    """All ids are there once, bins are gapless and not too long."""
    bins, docs = {}, {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for doc, text in rows:
        ids = np.append(ids_of(text), 2).astype("<u4")
        own = sorted(docs[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    return bins


def test_packed_documents(spark):
    rows = [*enumerate([*ODD, *odd_texts(3, 100)])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = packing.pack_documents(df, BYTES, RANKS, public_tokenizers.PATTERN).collect()
    whole = Tokenizer.from_file(BYTES)
    check_packing(rows, got, 1024, lambda t: whole.encode(t or "", add_special_tokens=False).ids)
    assert packing.pack_documents(df.limit(0), BYTES, RANKS, public_tokenizers.PATTERN).count() == 0


def test_best_fit_takes_the_fullest_that_fits():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7)] == [(0, 0), (1, 0)]
    assert fit.place(3) == (1, 7)  # fills the second
    assert fit.place(5) == (2, 0)  # two are open: 4 free, 5 free
    assert fit.place(8) == (3, 0)  # the fullest (4 free) closes
    assert fit.place(4) == (2, 5)
    with pytest.raises(ValueError):
        fit.place(11)


def test_best_fit_is_close_to_the_least():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1024) for _ in range(20_000)]
    fit = packing.BestFit(1024, 4096)
    for n in lengths:
        fit.place(n)
    assert fit.bins <= 1.02 * sum(lengths) / 1024


def test_pieces():
    assert packing.pieces(5, 10) == [(0, 5)]
    assert packing.pieces(10, 10) == [(0, 10)]
    assert packing.pieces(23, 10) == [(0, 3), (3, 10), (13, 10)]
    assert packing.pieces(20, 10) == [(0, 10), (10, 10)]


def test_packing_of_odd_rows(spark):
    """Null and repeated ids, repeated rows, clashing columns, a very long text."""
    rows = [(None, "a b c"), (None, None), (7, "one"), (7, "two words"), (7, "one"), (8, "word " * 30_000), (9, "")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id int, text string, piece string, length int").coalesce(1)
    got = packing.pack_documents(df, BYTES, RANKS, public_tokenizers.PATTERN).collect()
    whole = Tokenizer.from_file(BYTES)
    sizes = sorted(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    ends = sorted(r.start + r.length for r in got if r.doc_id != 8)
    assert ends == [n for n in sizes if n < 1024] and sum(r.length for r in got if r.doc_id == 8) == sizes[-1]
    assert sorted((r.doc_id for r in got if r.piece == 0), key=repr) == sorted((i for i, _ in rows), key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:], strict=False)) and sum(n for _, n in parts) <= 1024
