"""Instants kept as RFC 3339 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(col: Column | str) -> Column:
    """Timestamp of RFC 3339 text with any fraction and offset; null where it can't be read."""
    c = F.col(col) if isinstance(col, str) else col
    return F.upper(F.trim(c)).try_cast("timestamp")


def instant_us(col: Column | str) -> Column:
    """Microseconds since 1970 UTC of RFC 3339 text; finer digits are cut off."""
    return F.unix_micros(instant(col))


def none_if_empty(col: Column | str) -> Column:
    """Null for null and for empty text, which both mean none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c != "", c)


def bare(col: Column | str) -> Column:
    """Text without white space at its ends; null if nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    return none_if_empty(F.regexp_replace(c, r"^\s+|\s+$", ""))


def reference(col: Column | str) -> Column:
    """A reference: text without blanks around; null, empty and 0 refer to nothing."""
    b = bare(col)
    return F.when(b != "0", b)
