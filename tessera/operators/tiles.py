"""Running figures over one order of many rows, without a task that holds the whole sequence.

The axis of a sequence is cut into tiles of 2**BITS places. Within a tile a figure runs by a window; each tile's own total is one row; the totals
run over the tiles of a sequence, and what came before a tile is added to its rows. So a task sorts a tile, or the tiles' totals, whatever a
sequence's length. Callers first bring rows of the same place together where they can, so that a tile has as many rows as places at most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BITS = 20
TILE = "_tile"
_OVER = {"max": F.max, "min": F.min, "sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}


def tiled(df: DataFrame, place: str) -> DataFrame:
    """Adds the tile of a place: whole or other numbers, dates by day, times by second. Places of other types have no tiles: their sequence is one."""
    kind, c = df.schema[place].dataType, F.col(place)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        at = F.shiftright(F.unix_seconds(c.cast("timestamp")), BITS)
    elif isinstance(kind, T.DateType):
        at = F.shiftright(F.unix_date(c).cast("long"), BITS)
    elif isinstance(kind, T.IntegralType):
        at = F.shiftright(c.cast("long"), BITS)
    elif isinstance(kind, T.NumericType):
        at = F.floor(c / F.lit(float(1 << BITS))).cast("long")
    else:
        at = F.lit(0).cast("long")
    return df.withColumn(TILE, at)


def _total(kind: str, value: Column, order: Sequence[str]) -> Column:
    if kind != "last":
        return _OVER[kind](value)
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], figures: dict[str, tuple[str, Column]], inclusive: bool = True, reverse: bool = False, then: Sequence[str] = (), after: dict[str, tuple[str, Column]] | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Adds figures to tiled rows: name -> (max, min, sum or last that isn't null; value) over the rows of the sequence before a row in the order, and the row itself if inclusive.

    reverse: the rows of `order` from the last back; `then` orders equal ones, forward in either case. `last` takes forward orders only. after: further figures, over the rows
    after a row, in the whole order turned round. marks: tiled rows that make the same totals as df, with every tile of df, if there are fewer of them.
    What came before a tile is the first row of its window, so that rows are shuffled once, by tile, for all figures."""
    back, after = F.desc if reverse else F.asc, after or {}
    sort = [*(back(c) for c in order), *then]
    turned = [*((F.asc if reverse else F.desc)(c) for c in order), *(F.desc(c) for c in then)]
    every = [(n, k, v, sort, back) for n, (k, v) in figures.items()] + [(n, k, v, turned, F.asc if reverse else F.desc) for n, (k, v) in after.items()]
    # of each tile, one row
    totals = (df if marks is None else marks).groupBy(*by, TILE).agg(*[_total(kind, value, [*order, *then]).alias(name) for name, kind, value, _, _ in every])
    past = lambda to: Window.partitionBy(*by).orderBy(to(TILE)).rowsBetween(Window.unboundedPreceding, -1)
    carried = lambda name, kind, to: F.coalesce(_OVER[kind](name).over(past(to)), F.lit(0)) if kind == "sum" else _OVER[kind](name).over(past(to))
    heads = totals.select(*by, TILE, F.lit(0).alias("_h"), *[carried(name, kind, to).alias(f"_v_{name}") for name, kind, _, _, to in every])
    rows = df.select("*", F.lit(1).alias("_h"), *[value.alias(f"_v_{name}") for name, _, value, _, _ in every]).unionByName(heads, allowMissingColumns=True)
    here = lambda by_: Window.partitionBy(*by, TILE).orderBy("_h", *by_).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    names = {name for name, *_ in every}
    out = rows.select("_h", *[F.col(c) for c in df.columns if c not in names], *[_OVER[kind](F.col(f"_v_{name}")).over(here(by_)).alias(name) for name, kind, _, by_, _ in every])
    return out.where("_h = 1").drop("_h")
