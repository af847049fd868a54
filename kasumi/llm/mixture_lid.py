"""Languages of a document as a mixture, by expectation-maximisation over n-grams.

A language's model is the smoothed likelihood of hashed byte 4-grams of lower-case
words. A document is a run of windows of ``WINDOW`` n-grams; a window's likelihood
under a language is the product over its n-grams, tempered because n-grams
overlap. Expectation-maximisation finds the proportions of the languages. Of the
sets made of the most likely language, the two most likely ones and so on, the
one with the best penalised likelihood is kept, and the language with the largest
proportion in it is the prediction.

A text's likeness says how far its n-grams are from chance: 0 if they are as likely,
under the languages chosen and in their proportions, as n-grams in random buckets,
1 if as likely as those that the languages were learnt from. Where a least likeness
is asked for, a text below it is ``und``; one of less than a window is not judged.

Models are fitted on at most about ``TRAIN_ROWS`` documents of each of the
``MOST_LANGUAGES`` languages with most documents, those of the smallest hashes of
their ids, so that a column full of odd names takes no more of the driver.

Nulls and edge cases: a null text or one without a letter is ``und`` with score
0, as is every text when nothing can be learnt; a row without an id is predicted
but teaches nothing; ties go to the language that sorts first; texts of any
length are read whole; repeated rows are predicted alike; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kasumi.llm.common import runs, strings

#: Documents of a language to learn from; hash buckets; n-grams in a window; their overlap.
TRAIN_ROWS, BITS, WINDOW, TEMPER = 4_000, 17, 24, 4.0
#: Rounds of expectation-maximisation; pseudo-windows shared by all languages; likelihood that one more language must bring.
ROUNDS, PRIOR, PENALTY = 12, 0.5, 3.0
#: Languages that are learnt, those of most documents; a model has half a megabyte for each.
MOST_LANGUAGES = 128
UNKNOWN = "und"
#: The likeness below which a text fits no language: twice what random letters reach.
LEAST_LIKENESS = 0.04
LETTER = regex.compile(r"\p{L}")
#: Bytes kept as they are: small letters and all beyond ASCII; the others part words.
KEPT = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint8)


def grams(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hash buckets of all texts' 4-grams in turn, and where each text's begin (one more at the end)."""
    raw = [b"  " + x.lower().encode() + b"  " for x in texts]
    ends = np.cumsum([len(x) for x in raw])
    own = KEPT[np.frombuffer(b"".join(raw), np.uint8)]
    blank = own == 32
    keep = np.ones(len(own), dtype=bool)
    keep[2:] = ~(blank[2:] & blank[1:-1] & blank[:-2])  # runs of blanks as two
    kept = own[keep].astype(np.uint32)
    counted = np.concatenate([[0], np.cumsum(keep)])
    starts = counted[np.concatenate([[0], ends])]
    if len(kept) < 4:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    key = kept[:-3] << 24 | kept[1:-2] << 16 | kept[2:-1] << 8 | kept[3:]
    return (key * np.uint32(2654435761) >> np.uint32(32 - bits)).astype(np.int64), np.minimum(starts, len(key))


@dataclass(frozen=True)
class Model:
    """Languages, and the log-likelihood of each bucket under each."""

    languages: tuple[str, ...]
    table: np.ndarray

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray], smoothing: float = 0.5) -> Model:
        names = tuple(sorted(counts))
        if not names:
            return cls((), np.zeros((0, 0), np.float32))
        own = np.stack([counts[x] for x in names], axis=1).astype(np.float64) + smoothing
        return cls(names, (np.log(own) - np.log(own.sum(axis=0))).astype(np.float32))

    def mixtures(self, texts: list[str]) -> np.ndarray:
        """Texts by languages: the proportions, zero for languages outside the set chosen."""
        return self.judged(texts)[0]

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The mixtures and each text's likeness."""
        n, bits = len(self.languages), int(self.table.shape[0]).bit_length() - 1
        buckets, starts = grams(texts, bits)
        sizes = np.diff(starts)
        windows = np.maximum(1, -(-sizes // WINDOW))
        first = np.concatenate([[0], np.cumsum(windows)[:-1]])
        doc = np.repeat(np.arange(len(texts)), windows)
        at = starts[doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
        empty = sizes == 0
        logs = np.empty((len(doc), n))
        for k in range(n):
            own = np.append(self.table[buckets, k], np.float32(0))
            logs[:, k] = np.add.reduceat(own, np.minimum(at, len(own) - 1)) / TEMPER
        logs[empty[doc]] = 0
        peak = logs.max(axis=1)
        odds = np.exp(logs - peak[:, None])

        def solve(docs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Proportions and log-likelihood of some documents, each with its allowed languages."""
            begin, count = first[docs], windows[docs]
            local = np.repeat(np.arange(len(docs)), count)
            offset = np.concatenate([[0], np.cumsum(count)[:-1]])
            rows = begin[local] + np.arange(len(local)) - offset[local]
            part = odds[rows] * allowed[local]
            share = allowed / allowed.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                held = part * share[local]
                held /= np.maximum(held.sum(axis=1, keepdims=True), 1e-300)
                share = (np.add.reduceat(held, offset, axis=0) + PRIOR * allowed / allowed.sum(axis=1, keepdims=True)) / (count + PRIOR)[:, None]
            likely = np.log(np.maximum((part * share[local]).sum(axis=1), 1e-300)) + peak[rows]
            return share, np.add.reduceat(likely, offset)

        everyone = np.arange(len(texts))
        share, _ = solve(everyone, np.ones((len(texts), n)))
        order = np.argsort(-share, axis=1, kind="stable")
        chosen, best = np.zeros((len(texts), n)), np.full(len(texts), -np.inf)
        left = everyone
        for size in range(1, n + 1):
            allowed = np.zeros((len(left), n))
            np.put_along_axis(allowed, order[left][:, :size], 1.0, axis=1)
            some, likely = solve(left, allowed)
            value = likely - PENALTY * size * np.log1p(windows[left])
            better = value > best[left]
            chosen[left[better]], best[left[better]] = some[better], value[better]
            if size == 1:
                # one window tells nothing of a mixture; its doubt is that of all languages
                alone = chosen > 0
                chosen[alone] = share[alone]
            left = left[better]
            if not len(left):
                break
        chance = self.table.mean(axis=0, dtype=np.float64)
        learnt = (np.exp(self.table) * self.table).sum(axis=0, dtype=np.float64)
        each = np.add.reduceat(logs, first, axis=0) * TEMPER / np.maximum(sizes, 1)[:, None]
        likeness = (chosen / chosen.sum(axis=1, keepdims=True) * (each - chance) / np.maximum(learnt - chance, 1e-9)).sum(axis=1)
        return chosen, np.where(sizes < WINDOW, 1.0, likeness)


def learn(docs: DataFrame, *, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, bits: int = BITS) -> Model:
    """A model of the usable rows' languages. Only languages by buckets come to the driver."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if usable is None else usable).alias("usable"))
    known = docs.where("usable and id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not sizes:
        return Model.fit({})
    known = known.where(F.col("lang").isin(list(sizes)))
    shares = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, rows / n))))
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.element_at(shares, F.col("lang")) * (1 << 30)).select("lang", "text", "id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), strings(batch, "text"), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for some in runs(texts):
                    totals[lang] = totals.get(lang, 0) + np.bincount(grams(texts[some], bits)[0], minlength=1 << bits)
        for lang, total in totals.items():
            there = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there), pa.array(total[there])], names=["lang", "bucket", "n"])

    summed = picked.repartition(max(8, len(sizes)), F.xxhash64("id")).mapInArrow(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = {lang: np.zeros(1 << bits, dtype=np.int64) for lang in sizes}
    langs = np.array(summed.column("lang").to_pylist(), dtype=object)
    buckets, n = summed.column("bucket").to_numpy(), summed.column("n").to_numpy()
    for lang in sizes:
        own = langs == lang
        counts[lang][buckets[own]] = n[own]
    return Model.fit(counts)


def predict(docs: DataFrame, model: Model, *, keep: list[str], text_col: str = "text", least: float | None = None) -> DataFrame:
    """The kept columns, lang_pred, score (its proportion) and languages (the set chosen, largest first), which take the places of columns of those names. Texts with a likeness under ``least`` are ``und``."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "languages")]
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**BITS x 4 bytes, whatever the input
    kept = docs.select(*keep).schema

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = strings(batch, "__text")
            found, score, sets = np.full(len(texts), len(model.languages)), np.zeros(len(texts)), [[] for _ in texts]
            lettered = np.array([k for k, x in enumerate(texts) if model.languages and LETTER.search(x)], dtype=np.int64)
            known = [texts[k] for k in lettered]
            for run in runs(known):
                some, (mixture, likeness) = lettered[run], model.judged(known[run])
                if least is not None:
                    some, mixture = some[likeness >= least], mixture[likeness >= least]
                found[some], score[some] = mixture.argmax(axis=1), np.clip(mixture.max(axis=1), 0, 1)
                for k, own in zip(some, mixture, strict=True):
                    sets[k] = [names[x] for x in np.argsort(-own, kind="stable") if own[x] > 0]
            columns = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[found].tolist(), pa.string()), pa.array(score), pa.array(sets, pa.list_(pa.string()))], names=[*kept.names, "lang_pred", "score", "languages"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(predicted, f"{fields}, lang_pred string, score double, languages array<string>")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false without an id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
