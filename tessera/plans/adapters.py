"""The driver tables as interval sets, points and the like, for Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.plans.catalogue import table

A_SQL = """(SELECT DISTINCT l_suppkey % 22 + 1 AS chr, l_orderkey * 4 + l_linenumber AS "from", l_orderkey * 4 + l_linenumber + CAST(floor(l_quantity) AS BIGINT) - 1 AS "to",
  (l_suppkey % 22 + 1) * 1000000000000 + (l_orderkey * 4 + l_linenumber) * 100 + CAST(floor(l_quantity) AS BIGINT) AS id FROM lineitem)"""
B_SQL = """(SELECT o_custkey % 22 + 1 AS chr, o_orderkey * 4 AS "from", o_orderkey * 4 + CAST(floor(o_totalprice) AS BIGINT) % 50 AS "to", o_orderkey AS id FROM orders)"""
P_SQL = """(SELECT user_id % 22 + 1 AS chr, CAST(floor(epoch(ts)) AS BIGINT) AS pos, value, event_id AS id, user_id, event_type FROM events)"""


def intervals_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct intervals of lineitem: chr by supplier, from by order and line, as wide as the quantity."""
    width = F.floor("l_quantity").cast("long")
    chr_, start = (F.col("l_suppkey") % 22 + 1).cast("long"), (F.col("l_orderkey") * 4 + F.col("l_linenumber")).cast("long")
    return table(spark, sf_dir, "lineitem").select(chr_.alias("chr"), start.alias("from"), (start + width - 1).alias("to"), (chr_ * 1000000000000 + start * 100 + width).alias("id")).distinct()


def intervals_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of orders: chr by customer, from by order."""
    start = (F.col("o_orderkey") * 4).cast("long")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 22 + 1).cast("long").alias("chr"), start.alias("from"), (start + F.floor("o_totalprice").cast("long") % 50).alias("to"), F.col("o_orderkey").alias("id"))


def seconds(column: str):
    """Whole seconds since 1970 of a timestamp."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / 1000000).cast("long")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of events: chr by user, pos in seconds."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 22 + 1).cast("long").alias("chr"), seconds("ts").alias("pos"), "value", F.col("event_id").alias("id"), "user_id", "event_type")
