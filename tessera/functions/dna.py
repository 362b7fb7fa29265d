"""Sequences of symbols as strings: a for adenine and so on, in lower case; other letters are as in the IUPAC code. Null gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Each IUPAC symbol and its complement.
SYMBOLS = "acgtrykmbdhvswnu"
COMPLEMENT = "tgcayrmkvhdbswna"


def complement(c: Column) -> Column:
    return F.translate(c, SYMBOLS + SYMBOLS.upper(), COMPLEMENT + COMPLEMENT.upper())


def reverse_complement(c: Column) -> Column:
    return F.reverse(complement(c))


def only(c: Column, symbols: str) -> Column:
    """The symbols of a class, in order, lower-cased."""
    return F.regexp_replace(F.lower(c), f"[^{symbols}]", "")


def count(c: Column, symbols: str) -> Column:
    """How many characters are of a class: letters; `!` and letters for all but these; `other` for all but acgt. Case doesn't matter."""
    if symbols == "other":
        symbols = "!acgt"
    if symbols.startswith("!"):
        return F.length(c) - count(c, symbols[1:])
    letters = "".join(sorted({*symbols.lower(), *symbols.upper()}))
    return (F.length(c) - F.length(F.translate(c, letters, ""))).cast("long")


def gc(c: Column) -> Column:
    """Share of g and c among acgt; null where there are none."""
    return F.try_divide(count(c, "gc").cast("double"), count(c, "acgt"))


def hamming(a: Column, b: Column) -> Column:
    """Number of places at which two sequences differ; places that one lacks differ."""
    chars = lambda c: F.split(c, "")
    return F.aggregate(F.zip_with(chars(a), chars(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def subseq(c: Column, start: int, end: int) -> Column:
    """From start to end, from 1, both included."""
    return F.substring(c, start, end - start + 1)


def bins(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, bin (from 0) and the text of each bin of `width` characters; the last may be short. Empty texts have none. The text is cut in one pass."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), 0)
    return df.where(F.length(text) > 0).select(key, F.posexplode_outer(parts).alias("bin", "part"))


def allowed_runs(df: DataFrame, key: str, text: str, symbols: str = "acgt") -> DataFrame:
    """key, from and to of the maximal runs of allowed symbols. The text is cut at them: runs and gaps alternate, and their lengths add up to places."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"[{symbols}]+|[^{symbols}]+"), 0)
    rows = df.select(key, F.posexplode(runs).alias("i", "run"))
    end = F.sum(F.length("run")).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("to", end).where(F.col("run").rlike(f"^[{symbols}]")).select(key, (F.col("to") - F.length("run") + 1).alias("from"), "to")
