"""The list of surfaces that people have found harmless."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kasumi import values as V
from kasumi.functions.text import normal, normalize
from kasumi.operators.dictionary import sized


@dataclass(frozen=True)
class Allowlist:
    """Surfaces that match whole, and those that also match as parts (at borders of tokens or sub-words)."""

    exact: frozenset[str] = frozenset()
    embed: frozenset[str] = frozenset()

    @classmethod
    def of(cls, entries: list[str | tuple[str, bool]]) -> Allowlist:
        pairs = [(e, False) if isinstance(e, str) else e for e in entries]
        kept = [(s.strip(), part) for s, part in pairs if s.strip()]
        return cls(frozenset(normal(s) for s, _ in kept), frozenset(normal(s) for s, part in kept if part))

    def __bool__(self) -> bool:
        return bool(self.exact)


def _has_run(units: list[str], keys: frozenset[str], longest: int) -> bool:
    for i in range(len(units)):
        text = ""
        for unit in units[i : i + V.MAX_TOKENS]:
            text += unit
            if len(text) > longest:
                break
            if text in keys:
                return True
    return False


def embeds(surface: Column, covered: Column, allowlist: Allowlist) -> Column:
    """Whether runs of tokens (``covered``, their surfaces) or of sub-words inside one make a key; without tokens, sub-words of the surface."""
    keys = allowlist.embed
    longest = max(map(len, keys), default=0)

    @pandas_udf("boolean")
    def found(surfaces: pd.Series, tokens: pd.Series) -> pd.Series:
        cut = re.compile(V.SUBWORD).findall

        def one(s: str | None, ts: list[str] | None) -> bool:
            if s is None:
                return False
            if ts is None or not len(ts):
                return _has_run([normal(x) for x in cut(s)], keys, longest)
            return _has_run([normal(t) for t in ts], keys, longest) or any(_has_run([normal(x) for x in cut(t)], keys, longest) for t in ts)

        return pd.Series([one(s, t) for s, t in zip(surfaces, tokens, strict=True)], dtype="bool")

    return found(surface, covered)


def exclude(candidates: DataFrame, allowlist: Allowlist, tokens: DataFrame | None = None, *, key: str = "doc_id") -> DataFrame:
    """Candidates without a dictionary vote that match are set to the excluded level; nothing is detected anew."""
    if not allowlist:
        return candidates
    known = candidates.sparkSession.createDataFrame([(x, True) for x in sorted(allowlist.exact)], "__name string, __known boolean")
    candidates = candidates.withColumn("__name", normalize(F.col("surface"))).join(sized(known, len(allowlist.exact)), "__name", "left").drop("__name")
    matched = F.coalesce("__known", F.lit(False))
    if allowlist.embed:
        if tokens is not None:
            c, t = candidates.select(key, "start", "end").distinct().alias("c"), tokens.alias("t")
            inside = c.join(t, (F.col(f"c.{key}") == F.col(f"t.{key}")) & (F.col("c.start") <= F.col("t.start")) & (F.col("t.end") <= F.col("c.end")))
            covered = inside.groupBy(F.col(f"c.{key}").alias(key), F.col("c.start").alias("start"), F.col("c.end").alias("end")).agg(F.array_sort(F.collect_list(F.struct("t.i", "t.surface"))).alias("x"))
            candidates = candidates.join(covered.select(key, "start", "end", F.col("x.surface").alias("__covered")), [key, "start", "end"], "left")
        else:
            candidates = candidates.withColumn("__covered", F.lit(None).cast("array<string>"))
        matched = matched | embeds(F.col("surface"), F.col("__covered"), allowlist)
    protected = F.exists("votes", lambda v: v["channel"] == V.DICT)
    return candidates.withColumn("confidence", F.when(~protected & matched, F.lit(V.EXCLUDED)).otherwise(F.col("confidence"))).drop("__covered", "__known")
