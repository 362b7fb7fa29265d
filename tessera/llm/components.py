"""Connected components by alternating large and small stars; of edges that are counted and found few, by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from tessera.llm import scan
from tessera.runtime import cut

#: Edges up to which one task finds their components: 16 MB of ids. Rounds of stars are many plans and jobs, which the driver holds.
FEW = 1 << 20


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v), u > v. Large: every greater neighbour of a node is linked to the node's least one; small: every lesser neighbour, and the node."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def directed(edges: DataFrame) -> DataFrame:
    """Edges (a, b) as distinct (u, v), u > v."""
    return edges.toDF("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and the least node of each one's component: the greater of two edges' least nodes so far is put under the lesser until none differ."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, up = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            return nodes, nodes[up]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]


def _solved(edges: DataFrame) -> DataFrame:
    """What settle() gives, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, least = least_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            below = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[below], pa.int64()), pa.array(least[below], pa.int64())], ["u", "v"])

    return cut(scan.map_batches(edges.select("u", "v").repartition(1), run, "u long, v long"))


def contract(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges (u, v) with the same components after some rounds; each is written to the shared folder. Few edges are settled."""
    if edges.count() <= FEW:
        return _solved(edges)
    for _ in range(rounds):
        edges = cut(_star(_star(edges, True), False))
    return edges


def settle(edges: DataFrame) -> DataFrame:
    """Rounds until nothing changes: every node is then linked to the least of its component, and to nothing else. The rounds grow with the logarithm of the
    number of nodes."""
    if edges.count() <= FEW:
        return _solved(edges)
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if mark == before or mark[0] == 0:
            return edges
        before, edges = mark, contract(edges, 1)


def labels(edges: DataFrame) -> DataFrame:
    """(node, component) of each node that has a lesser neighbour: the least of these. After settle() that is the component's least node; before, nodes of one
    label are connected, but a component may have several labels."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (a, b) but the least of each component, component being that least node."""
    return labels(settle(cut(directed(edges))))
