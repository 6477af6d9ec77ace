"""Column builders for text, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def letters_digits(c: Column | str) -> Column:
    """Lower case without any character that is not a Unicode letter or number; null gives the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends (``trim`` only removes spaces); null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column | str) -> Column:
    """Stripped text, null where nothing is left."""
    s = strip(c)
    return F.when(s != "", s)


def one_spaced(c: Column | str) -> Column:
    """Lower case, stripped, inner white space as one space."""
    c = F.col(c) if isinstance(c, str) else c
    return strip(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))


def words(c: Column | str) -> Column:
    """The runs of Unicode letters and numbers in lower case, in order; text without any gives one empty word."""
    c = F.col(c) if isinstance(c, str) else c
    return F.split(F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", " "))), " ")
