"""String functions as column expressions. Null gives null."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def trim(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def truncate(c: Column, n: int, dots: str = "...") -> Column:
    """At most n characters, the last of which are dots where some are cut off."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - len(dots)), F.lit(dots))).otherwise(c)


def split(c: Column, pattern: str) -> Column:
    return F.split(c, pattern)


def quote(literal: str) -> str:
    """A pattern that matches a text as it is."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", literal)


def reverse(c: Column) -> Column:
    return F.reverse(c)


def positions(c: Column, char: str) -> Column:
    """Places (from 1) of a character, as an array. The text is cut at the character: each piece's length gives the next place."""
    parts = F.split(c, quote(char), -1)
    lengths = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.length(p) + len(char))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(lengths, start, lambda s, n: F.struct((s.at + n).alias("at"), F.concat(s.all, F.array(s.at + n - len(char) + 1)).alias("all")), lambda s: s.all)


def matches(c: Column, pattern: str) -> Column:
    """All matches of a pattern, as an array."""
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def to_base(c: Column, base: int) -> Column:
    return F.conv(c.cast("string"), 10, base)
