"""Lexical search in several languages: one analyser per language, required groups of alternatives, fused rankings.

An analyser is two things that agree: a column expression that makes the terms of a text, inside the JVM, and a function
that makes the groups of a query. A text matches if it has a term of every group.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion; fixed value.
RRF_K = 60
# Affixes of the light Arabic analyser, in the order they are tried; fixed values.
PREFIXES = ("وال", "فال", "بال", "كال", "لال", "ال", "لل", "و", "ف", "ب", "ك", "ل")
SUFFIXES = ("ها", "ان", "ات", "ون", "ين", "يه", "ية", "ه", "ة", "ي")
#: Marks and the stretching sign, which are left out, as a character class.
_MARKS = r"[ً-ْٰـ]"
_DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ー]+"
_DENSE_PY = re.compile(r"[ᄀ-ᇿ々ぁ-ヿ㐀-䶿一-鿿가-힯豈-﫿]+")


@dataclass(frozen=True)
class Analyser:
    """terms: text column -> array of terms; groups: query -> groups of alternatives, none if the query has nothing for it."""

    terms: Callable[[Column], Column]
    groups: Callable[[str], list[list[str]]]


def _arabic_terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.regexp_replace(F.lower(text), _MARKS, ""), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

    def prefix(w: Column) -> Column:
        out = w
        for p in reversed(PREFIXES):
            least = max(2 + len(p), 4 if p == "و" else 0)
            out = F.when(F.startswith(w, F.lit(p)) & (F.length(w) >= least), F.substring(w, len(p) + 1, 1_000_000)).otherwise(out)
        return out

    def stem(w: Column) -> Column:
        out = prefix(w)
        for s in SUFFIXES:
            out = F.regexp_replace(out, f"(?<=.{{2}}){s}$", "")
        return out

    four = F.transform(words, lambda w: F.array(w, prefix(w), stem(w), stem(prefix(w))))
    return F.array_distinct(F.flatten(four))


def _arabic_alternatives(word: str) -> list[str]:
    def prefix(w: str) -> str:
        return next((w[len(p) :] for p in PREFIXES if w.startswith(p) and len(w) >= max(2 + len(p), 4 if p == "و" else 0)), w)

    def stem(w: str) -> str:
        return reduce(lambda x, s: x[: -len(s)] if x.endswith(s) and len(x) - len(s) >= 2 else x, SUFFIXES, prefix(w))

    return list(dict.fromkeys([word, prefix(word), stem(word), stem(prefix(word))]))


def _arabic_groups(query: str) -> list[list[str]]:
    words = re.findall(r"[^\W_]+", re.sub("[ً-ْٰـ]", "", query.lower()))
    return [_arabic_alternatives(w) for w in words]


def _dense_terms(text: Column) -> Column:
    """Runs of scripts that are written without blanks, as all their pairs of neighbours and single characters."""
    runs = F.regexp_extract_all(text, F.lit(_DENSE), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    single = F.flatten(F.transform(runs, lambda r: F.split(r, "")))
    return F.array_distinct(F.concat(pairs, single))


def _dense_groups(query: str) -> list[list[str]]:
    runs = _DENSE_PY.findall(unicodedata.normalize("NFC", query))
    return [[r[i : i + 2]] for r in runs for i in range(max(1, len(r) - 1))]


ANALYSERS: dict[str, Analyser] = {"arabic": Analyser(_arabic_terms, _arabic_groups), "dense": Analyser(_dense_terms, _dense_groups)}


def matching(df: DataFrame, text: str, query: str, language: str) -> DataFrame | None:
    """Rows whose text has a term of every group of the query in a language; None if the query has no group."""
    a = ANALYSERS[language]
    groups = a.groups(query)
    if not groups:
        return None
    if language == "dense":
        # what the pairs of a run allow but the run itself doesn't is left out; plain containment prunes before any term is made
        hit = reduce(Column.__and__, [F.contains(F.col(text), F.lit(r)) for r in _DENSE_PY.findall(unicodedata.normalize("NFC", query))])
        return df.where(hit)
    # a term is a part of the text, so plain containment prunes before any term is made
    bare = F.regexp_replace(F.lower(F.col(text)), _MARKS, "")
    df = df.where(reduce(Column.__and__, [reduce(Column.__or__, [F.contains(bare, F.lit(t)) for t in g]) for g in groups]))
    terms = a.terms(F.col(text))
    return df.withColumn("_terms", terms).where(reduce(Column.__and__, [F.arrays_overlap("_terms", F.array(*[F.lit(t) for t in g])) for g in groups])).drop("_terms")


def fuse(rankings: list[DataFrame], key: str, order: list[Column], limit: int) -> DataFrame:
    """The best rows over several rankings by the sum of 1 / (60 + rank); ties go by `order`. Each is cut to its first rows before."""
    ranked = [r.withColumn("_rank", F.row_number().over(Window.orderBy(*order))) for r in rankings]  # over a bounded number of rows each
    both = reduce(DataFrame.unionByName, ranked)
    names = [c for c in rankings[0].columns if c != key]
    fused = both.groupBy(key).agg(F.first(F.struct(*names)).alias("_s"), F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("_rank"))), 9).alias("score")).select(key, "_s.*", "score")
    return fused.orderBy(F.desc("score"), *order).limit(limit)
