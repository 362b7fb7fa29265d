"""Arrays, maps and small matrices as column expressions and DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def translate(c: Column, names: Column) -> Column:
    """The value of a key in a map; keys that it lacks stay as they are."""
    return F.coalesce(F.element_at(names, c), c)


def reverse(df: DataFrame, key: str, values: str) -> DataFrame:
    """value and keys, sorted: of rows of a key and an array of values, each value with the keys that have it."""
    return df.select(key, F.explode(values).alias("value")).groupBy("value").agg(F.sort_array(F.collect_set(key)).alias("keys"))


def mixin(into: Column, more: Column) -> Column:
    """A map with the values of another for the keys that both have."""
    return F.transform_values(into, lambda k, v: F.coalesce(F.element_at(more, k), v))


def cross_product(df: DataFrame, row: str, left: dict[str, Column], right: dict[str, Column], f: Callable[[Column, Column], Column] = lambda a, b: F.sum(a * b)) -> DataFrame:
    """row_name, column_name and value of the matrix of an aggregate over the rows of df, for each of the left columns with each of the right. As many rows as pairs of columns given."""
    cells = [f(a, b).alias(f"v{i}_{j}") for i, a in enumerate(left.values()) for j, b in enumerate(right.values())]
    one = df.agg(*cells)
    names = [(x, y, f"v{i}_{j}") for i, x in enumerate(left) for j, y in enumerate(right)]
    rows = F.array(*[F.struct(F.lit(x).alias(row), F.lit(y).alias("column_name"), F.col(v).cast("double").alias("value")) for x, y, v in names])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def from_upper(c: Column, n: int, diagonal: bool = False) -> Column:
    """A symmetric matrix, as an array of rows, from its upper triangle by columns; the diagonal is null if it isn't given."""
    def at(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        if i == j and not diagonal:
            return F.lit(None).cast("double")
        return F.get(c, F.lit(j * (j + 1) // 2 + i if diagonal else j * (j - 1) // 2 + i)).cast("double")

    return F.array(*[F.array(*[at(i, j) for j in range(n)]) for i in range(n)])


def to_upper(c: Column, n: int, diagonal: bool = False) -> Column:
    """The upper triangle of a matrix, by columns."""
    return F.array(*[F.get(F.get(c, F.lit(i)), F.lit(j)) for j in range(n) for i in range(j + 1 if diagonal else j)])
