"""Column expressions the JVM-side operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters between words.
SEPARATORS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often and however deep ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """The integers 0 .. n - 1 as an array, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def words(text: Column) -> Column:
    """Words of a text as an array; none for a null or blank text."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def hashed_window(parts: Column, i: Column, width: int) -> Column:
    """Hash of ``width`` neighbouring entries of an array."""
    return F.xxhash64(*(F.get(parts, i + k) for k in range(width)))
