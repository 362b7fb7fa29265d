"""Draws that depend on a key alone, so that a task that runs again draws alike, and that any engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Hexadecimal digits of a draw: 52 bits, all of which a double holds.
DIGITS = 13


def draw(seed: int, *columns: str) -> Column:
    """A whole number below 2**52, by the texts of the columns. Nulls are passed over."""
    said = F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def unit(seed: int, *columns: str) -> Column:
    """Between 0 and 1, both excluded."""
    return (draw(seed, *columns) + 0.5) / float(1 << 4 * DIGITS)


def draw_sql(seed: int, *columns: str) -> str:
    """The same in DuckDB's SQL."""
    return f"CAST('0x' || left(md5(concat_ws('/', '{seed}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)})), {DIGITS}) AS BIGINT)"


def unit_sql(seed: int, *columns: str) -> str:
    return f"(({draw_sql(seed, *columns)} + 0.5) / {1 << 4 * DIGITS}.0)"
