"""Connected components: few edges are joined in one task, others by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, tidy

#: Up to so many edges between longs are joined in one task; beyond, rounds of joins give the same.
_HELD = 1_000_000
_ROWS = 65_536


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each is connected with) of edges (a, b)."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    parent = np.arange(len(nodes))
    while len(i):
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))  # i and j are roots
        while ((up := parent[parent]) != parent).any():
            parent = up
        i, j = parent[i], parent[j]
        apart = i != j
        i, j = i[apart], j[apart]
    return nodes, nodes[parent]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy().copy(), b.column("b").to_numpy().copy()) for b in batches]
        if held:
            node, component = _joined(*map(np.concatenate, zip(*held)))
            for s in range(0, len(node), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[s : s + _ROWS]) for x in (node, component)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(tidy(run), "node long, component long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b), for every node that has an edge.

    Direction, repeats and loops don't matter; edges with a null are ignored.  Minima are
    aggregated before they are joined back, so a hub's edges are only ever split rows of a
    join, never one group.  Iterations grow with the logarithm of the longest path; each
    is cut into the checkpoint folder.  Up to ``_HELD`` edges take one task and no iterations.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if {t for _, t in now.dtypes} == {"bigint"} and now.count() <= _HELD:
        return _in_one_task(now)
    state = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == state or not row.n:
            break
        state = (row.n, row.h)
        now = cut(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
