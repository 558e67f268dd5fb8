"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour above a node to the least of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its neighbours below it to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, in order, and the least node that each is connected with."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        left = root[x] != root[y]
        x, y = x[left], y[left]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([batch.column(c).to_numpy() for c in ("a", "b")]) for batch in batches if batch.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*np.concatenate(parts, axis=1))], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, scratch: Scratch, one_task: int = 1 << 20) -> DataFrame:
    """Return ``(node, component)`` for every node of ``edges(a, b)``; a component is its least node.

    Edges may be repeated, in either direction, or loops, of which nothing is made. ``one_task`` edges, 16 MB,
    and fewer are followed in one task; more by steps, each a grouped minimum and a join, so that a node with
    very many neighbours costs one skewed join and no large group. The steps needed grow with the logarithm
    of the longest path, and the results are the same. No edges: no rows.
    """
    now = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    before = _state(now)
    if before[0] <= one_task:
        return scratch.write(_in_one_task(now), "components")
    while True:
        new = scratch.write(_small_star(_large_star(now).distinct()).distinct(), "stars")
        scratch.drop(now)
        now, after = new, _state(new)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return scratch.write(nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
