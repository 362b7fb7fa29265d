"""Nested records: search, pairs, and the closure of a parent relation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from tessera.functions import text


def find(df: DataFrame, key: str, pattern: str, literal: bool = False, full: bool = False, ignore_case: bool = False) -> DataFrame:
    """Rows whose key, a text or an array of texts, matches a pattern somewhere, or as a whole with full."""
    pattern = text.quote(pattern) if literal else pattern
    pattern = ("(?i)" if ignore_case else "") + (f"^(?:{pattern})$" if full else pattern)
    c = F.col(key)
    return df.where(F.exists(c, lambda x: x.rlike(pattern)) if isinstance(df.schema[key].dataType, T.ArrayType) else c.rlike(pattern))


def distinct_pairs(df: DataFrame, a: str, b: str, db: str, allowed: Sequence[str], qualifier: str | None = None) -> DataFrame:
    """Distinct (a, b) of rows whose db is allowed and whose qualifier, if there is one, is empty."""
    rows = df.where(F.col(db).isin(list(allowed)))
    if qualifier:
        rows = rows.where(F.coalesce(F.col(qualifier), F.lit("")) == "")
    return rows.select(a, b).distinct()


def inverse(df: DataFrame, key: str, parents: str) -> DataFrame:
    """parent and its sorted children, of rows with an array of parents."""
    return df.select(F.col(key).alias("child"), F.explode(parents).alias("parent")).groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("parent_of"))


def ancestors(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """child, ancestor and depth (the least number of steps) over edges (child, parent), up to a depth. Cycles end, as a pair is listed once.

    Without a bound, paths are doubled: pairs up to 2n steps come from joining pairs of up to n, so there are as many rounds as the depth has bits."""
    from tessera.runtime import cut

    known = cut(edges.where("child IS NOT NULL AND parent IS NOT NULL").select("child", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("depth")).distinct())
    reach = 1
    while depth is None or reach < depth:
        more = known.alias("x").join(known.alias("y"), F.expr("x.ancestor = y.child")).selectExpr("x.child AS child", "y.ancestor AS ancestor", "x.depth + y.depth AS depth")
        new = cut(known.unionByName(more).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        if depth is None and new.count() == known.count():
            break
        known, reach = new, reach * 2
    return known if depth is None else known.where(F.col("depth") <= depth)
