"""Text of messages: cleaning, the searchable text built of parts, labels for mentions, vectors as bytes."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StringType

#: Prefixes of the parts that quote another message; fixed values.
PREFIXES = {"reply_context": "reply:", "forward_context": "forward:"}


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t) if isinstance(t, str) else None)


def sanitize(col: Column | str) -> Column:
    """Text in compatibility form, runs of white space as one blank, without control and zero-width characters."""
    c = F.col(col) if isinstance(col, str) else col
    c = _nfkc(F.regexp_replace(c, "\ufffd", ""))
    # white space first: line ends and tabs are control characters, too
    c = F.regexp_replace(c, r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{Cc}\x{200b}-\x{200d}\x{feff}]", ""), " +", " "))


def searchable(parts: Column) -> Column:
    """Searchable text of an array of (kind, text) whose texts were sanitized: one line per part that isn't empty."""
    lines = F.transform(F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != ""), lambda p: F.concat(_prefix(p["kind"]), p["text"]))
    return F.array_join(lines, "\n")


def _prefix(kind: Column) -> Column:
    out = F.lit("")
    for k, v in PREFIXES.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def label_mentions(content: Column, mentions: Column) -> Column:
    """Content with each mention of the array (kind, id, name) replaced by its label.

    kind role is written <@&id>, channel <#id>, any other <@id> or <@!id>. A name that is null or blank is the id; an
    empty id is no mention. Null mentions change nothing.
    """

    def one(text: Column, m: Column) -> Column:
        target, name = F.trim(F.coalesce(m["id"], F.lit(""))), F.trim(F.coalesce(m["name"], F.lit("")))
        label = F.when(name == "", target).otherwise(name)
        role = F.replace(text, F.concat(F.lit("<@&"), target, F.lit(">")), F.concat(F.lit("@"), label))
        channel = F.replace(text, F.concat(F.lit("<#"), target, F.lit(">")), F.concat(F.lit("#"), label))
        user = F.replace(F.replace(text, F.concat(F.lit("<@"), target, F.lit(">")), F.concat(F.lit("@"), label)), F.concat(F.lit("<@!"), target, F.lit(">")), F.concat(F.lit("@"), label))
        kind = F.trim(m["kind"])
        return F.when(target == "", text).when(kind == "role", role).when(kind == "channel", channel).otherwise(user)

    return F.when(mentions.isNull(), content).otherwise(F.aggregate(mentions, content, one))


@F.pandas_udf(BinaryType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Vector as little-endian 32-bit floats; null and empty vectors are null."""
    return v.map(lambda x: np.asarray(x, "<f4").tobytes() if x is not None and len(x) else None)


@F.pandas_udf(ArrayType(FloatType()))
def decode_vector(b: pd.Series) -> pd.Series:
    """Vector of little-endian 32-bit floats; bytes that are none, or no whole number of floats, are null."""
    return b.map(lambda x: np.frombuffer(x, "<f4").tolist() if x and len(x) % 4 == 0 else None)


def duration(seconds: float) -> str:
    """A length of time as people write it, in its two largest units."""
    left, out = int(abs(seconds)), []
    for unit, size in (("d", 86_400), ("h", 3_600), ("m", 60), ("s", 1)):
        n, left = divmod(left, size)
        if n:
            out.append(f"{n}{unit}")
    return ("-" if seconds < 0 and out else "") + ("".join(out[:2]) or "0s")


def markdown(columns: list[str], rows: list[tuple]) -> str:
    """A ranked table as Markdown; bars and line ends in cells are escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| # | " + " | ".join(columns) + " |", "| ---: |" + " --- |" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join([str(i), *map(cell, r)]) + " |" for i, r in enumerate(rows, 1))])
