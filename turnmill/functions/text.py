"""Column functions on strings shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip removes.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space at either end, no-break spaces and line ends included."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """True for null, empty and white space only."""
    return c.isNull() | (strip(c) == "")


def ascii_slug(c: Column) -> Column:
    """Lower case a-z0-9 words joined by "_"; "unknown" where nothing is left."""
    s = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def unicode_slug(c: Column) -> Column:
    """Lower case; letters, digits and ". _ -" of any script stay, runs of the rest become "_"."""
    s = F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}._-]+", "_")
    return F.nullif(F.regexp_replace(s, "^[._-]+|[._-]+$", ""), F.lit(""))


def label_key(c: Column) -> Column:
    """A label without case, spacing and punctuation: "Open-Return " and "open_return" are one."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def number(c: Column) -> Column:
    """A plain decimal number written as text, outer space allowed; else null (NaN, hex and suffixed forms too)."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def lower_groups(c: Column, regex: str) -> Column:
    """The text with every match of regex replaced by its first group in lower case."""
    gaps = F.split(c, regex, -1)
    words = F.transform(F.regexp_extract_all(c, F.lit(regex), F.lit(1)), F.lower)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(words, i), F.lit("")))), "")


def first_present(*columns: str) -> Column:
    """The first of the columns that says something, without outer white space; null if none does."""
    return F.coalesce(*[F.nullif(strip(F.col(c)), F.lit("")) for c in columns])


def is_slug(c: Column, most: int = 128) -> Column:
    """Lower-case words of letters and digits joined by single ". _ -", at most `most` long; false for null."""
    return F.coalesce(c.rlike(r"^[a-z0-9]+([._-][a-z0-9]+)*$") & (F.length(c) <= most), F.lit(False))


def parent_slug(c: Column) -> Column:
    """What stands before the last dot; null at the top."""
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.[^.]*$", ""))
