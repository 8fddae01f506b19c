"""Connected components of an edge table, by alternating large-star and small-star
steps (Kiveris et al., 2014).  A table of at most ``MOST_EDGES`` edges takes one task
instead, since each step has some thousand tasks that the driver has to keep account of,
however few the edges are.  Only counts reach the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Edges (16 bytes each) that one task takes: the bound of its memory.
MOST_EDGES = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``a``-``b`` in ascending order, and the least node that each reaches."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return node, node[root]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[batch.column(k).to_numpy() for k in ("a", "b")] for batch in batches]
    if held:
        node, least = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(node), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(least[i : i + (1 << 16)])], ["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or smaller) neighbours to the least of its neighbourhood."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``: every node with an edge to
    another node, with the least node that it reaches.  Self-loops, repeated and
    reversed edges are harmless; no edges give no rows.  Stops when a round changes
    nothing, which takes rounds in the order of the logarithm of the longest path."""
    now = cut(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    if now.count() <= MOST_EDGES:
        return cut(now.coalesce(1).mapInArrow(_whole, "node long, component long"))
    seen = None
    for _ in range(most_rounds):
        now = cut(_star(_star(now, large=True), large=False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
