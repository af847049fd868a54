"""BPE by dynamic programming over the prefixes of a word.

The encoding of every prefix of a word ends with exactly one token. An automaton
gives the vocabulary's tokens that end at each place; of these, that one is the
last token whose predecessor (the last token of what comes before it) may stand
next to it, i.e. no merge across their border would have come before the merges
inside the two. One test of a pair decides it, and the tests are remembered.
Back-pointers from the end then give the ids, equal to those of merging by rank.

It holds for vocabularies in which every merge makes a token of its own from
older ones; others are refused when loaded.

A text is normalised and cut into words before: by a pattern where all its code
points are of certain classes, else by the normalizer and pre-tokenizer that the
vocabulary's file names. The tests hold every code point against the library.

Nulls and edge cases: null and empty texts have no ids; ids of documents may be
null or repeat; texts of any length are taken whole; an empty table gives no
rows; other columns are passed on only as asked for.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kasumi.llm.common import strings

#: Words whose ids a worker remembers, in two generations, and tests of pairs.
WORDS, PAIRS = 300_000, 1_000_000
#: Where the last symbol of a word goes, so that it differs from the same one inside a word.
END = 0xE000
NEVER = 1 << 62
#: What the words of a text are cut by where its Unicode classes are certain: code points below U+0250, and signs of
#: General Punctuation. Versions of Unicode differ elsewhere; other texts are normalised and cut by the file's own
#: normalizer and pre-tokenizer.
SIGNS = "‐-‧‰-⁞€"
UNCERTAIN = re.compile(f"[^\x00-ɏ{SIGNS}]")


def _ranges(kind: str, below: int = 0x250) -> str:
    return "".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c)).startswith(kind))


WORDS_OF = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_ranges('L')}]+|[{_ranges('N')}]|[^\t-\r \x85\xa0{_ranges('L')}{_ranges('N')}]+")


@functools.cache
def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class PrefixBpe:
    """Encodes words by dynamic programming over prefixes.

    ``vocab``: token to id; ``merges``: pairs by rank; ``suffix``: what marks a word's last symbol.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if made in self.parts or self.rank[left] >= r or self.rank[right] >= r:
                raise ValueError(f"merge {r} doesn't make a token of its own from older ones")
            self.merge_rank[left, right] = r
            self.parts[made] = left, right
            self.rank[made] = r
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        whole: dict[int, bool] = {}
        for token, i in sorted(vocab.items(), key=lambda x: self.rank[x[1]]):
            symbols = self.symbols(token)
            if i not in self.parts and len(symbols) > 1:
                continue  # no merge leads to it
            whole[i] = i not in self.parts or all(whole.get(p, False) for p in self.parts[i]) and self._border_holds(*self.parts[i], False)
            if whole[i]:  # else its own text is encoded otherwise, and it never comes about
                self.automaton.add_word(symbols, (len(symbols), i))
        self.automaton.make_automaton()

    def symbols(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            return self.mark(token[: -len(self.suffix)])
        return token

    def mark(self, word: str) -> str:
        return word[:-1] + chr(END + ord(word[-1])) if self.suffix else word

    def _border_holds(self, left: int, right: int, top: bool = True) -> bool:
        """Whether no merge joins the two across their border.

        It goes back in time, undoing the younger of the two merges beside the border. Each side exists until it is merged within its own token; merges of one rank go from left to right.
        """
        left_until = right_until = NEVER
        while True:
            joined = self.merge_rank.get((left, right)) if top else None
            if joined is not None and joined < left_until and joined <= right_until:
                return False
            top = True
            if self.rank[left] > self.rank[right]:
                left_until, left = self.rank[left], self.parts[left][1]
            elif self.rank[right] >= 0:
                right_until, right = self.rank[right], self.parts[right][0]
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word, given in the vocabulary's own symbols."""
        marked = self.mark(word)
        last: list[tuple[int, int] | None] = [None] * len(marked)
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter(marked):
            if last[end] is not None:
                continue
            start = end - length
            if start < 0:
                last[end] = start, token
                continue
            before = last[start]
            if before is None:
                continue
            key = before[1] << 32 | token
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) >= PAIRS:
                    pairs.clear()
                fits = pairs[key] = self._border_holds(before[1], token)
            if fits:
                last[end] = start, token
        ids, at = [], len(marked) - 1
        while at >= 0:
            found = last[at]
            if found is None:
                raise ValueError(f"the vocabulary lacks a symbol of {word!r}")
            at = found[0]
            ids.append(found[1])
        return ids[::-1]


class Remembered(dict):
    """Ids of words, and their tokens as text, by word; the less recent half goes when it is full."""

    def __init__(self, make, limit: int = WORDS):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        self[word] = value
        return value


class WordBpe:
    """A ``tokenizers`` file of a lower-casing BPE with word ends: ``encode`` and ``decode``."""

    def __init__(self, path: str):
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        model = held["model"]
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = PrefixBpe(self.vocab, merges, model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        # the file without its vocabulary: normalizer and pre-tokenizer alone
        self.parts = Tokenizer.from_str(json.dumps(held | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        symbols = byte_symbols()
        self.to_symbols = [symbols[b] for b in range(256)]
        self.ids_of = Remembered(self._ids_of)

    def _ids_of(self, word: str) -> bytes:
        ids = self.bpe.encode_word("".join(map(self.to_symbols.__getitem__, word.encode())))
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def words(self, text: str) -> list[str]:
        """Normalised and cut as the file's normalizer and pre-tokenizer do."""
        if text.isascii() or not UNCERTAIN.search(text):
            lowered = text.lower()
            if lowered.isascii() or not UNCERTAIN.search(lowered):  # a dotted capital I leaves the range
                return WORDS_OF.findall(lowered)
        normal = self.parts.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.parts.pre_tokenizer.pre_tokenize_str(normal)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not any(x in text for x in self.added):
            return b"".join(map(self.ids_of.__getitem__, self.words(text)))
        out = []
        for part in self.split.split(text):
            out += [self.added[part].to_bytes(4, "little")] if part in self.added else map(self.ids_of.__getitem__, self.words(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file, the tokens go side by side with a space between."""
        return " ".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One for each Python worker."""
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids of each whole text as little-endian unsigned 32-bit integers, and their text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            ids = [bpe.encode(x) for x in strings(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), text_col).mapInArrow(encoded, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of ``encode_documents``' rows."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
