"""Spanning forests, merging of small regions, and clustering."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.operators.graph import components
from cityloom.sources.scratch import cut


#: Edges between parts that one task finishes (five numbers each); more take rounds.
ONE_TASK = 1_000_000


def _kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    """The edges (a, b, w) of the least forest of the parts ``pa`` and ``pb``, ties by a, then b."""
    edges = edges.sort_values(["w", "a", "b"], na_position="first", ignore_index=True)
    ends, number = np.unique(edges[["pa", "pb"]].to_numpy(), return_inverse=True)
    parent = list(range(len(ends)))
    keep = []
    for k, (x, y) in enumerate(number.reshape(-1, 2).tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[x] = y
            keep.append(k)
    return edges.loc[keep, ["a", "b", "w"]]


def spanning_forest(nodes: DataFrame, edges: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """The edges (a, b, w) of the least spanning forest of ``nodes(id)``, ties by a, then b;
    ``edges`` has each pair once.  Rounds of Boruvka: each part takes its least edge to another
    part, so the parts are at least halved, and none is gathered in one task.  Once ``most``
    edges between parts are left, one task finishes."""
    near = lambda c: nodes.select(F.col("id").alias(c))
    edges = edges.join(near("a"), "a", "left_semi").join(near("b"), "b", "left_semi")
    open_ = cut(edges.select("a", "b", "w", F.col("a").alias("pa"), F.col("b").alias("pb")).where("a <> b"))
    chosen: list[DataFrame] = []
    while not open_.isEmpty():
        if open_.count() <= most:
            chosen.append(open_.repartition(1).mapInPandas(lambda frames: iter([_kruskal(pd.concat(frames))]), open_.select("a", "b", "w").schema))
            break
        ends = open_.select(F.explode(F.array("pa", "pb")).alias("p"), F.struct("w", "a", "b", "pa", "pb").alias("e"))
        best = cut(ends.groupBy("p").agg(F.min("e").alias("e")).select("e.*").distinct())
        chosen.append(best.select("a", "b", "w"))
        both = best.select(F.col("pa").alias("a"), F.col("pb").alias("b")).unionAll(best.select(F.col("pb").alias("a"), F.col("pa").alias("b")))
        joined = components(both.select(F.col("a").alias("id")).distinct(), cut(both))
        at = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias("to_" + c))  # noqa: B023, E731
        moved = open_.join(at("pa"), "pa").join(at("pb"), "pb").where("to_pa <> to_pb")
        # Of the edges between two parts only the least can be in the forest.
        pair = moved.groupBy(F.least("to_pa", "to_pb").alias("pa"), F.greatest("to_pa", "to_pb").alias("pb"))
        open_ = cut(pair.agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "pa", "pb"))
    return cut(reduce(DataFrame.unionAll, chosen)) if chosen else edges.select("a", "b", "w").limit(0)


def merge_group(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Regions of one zone: the smallest region under ``least`` joins the neighbour with which it
    shares most length (ties: the smaller region, then id), until none can."""
    size = dict(zip(group.id, group["size"], strict=True))
    region = {i: i for i in size}
    near: dict = {i: {} for i in size}
    for i, sides in zip(group.id, group.sides, strict=True):
        for s in sides if sides is not None else ():
            if s["b"] in size:
                near[i][s["b"]] = near[i].get(s["b"], 0.0) + s["len"]
    heap = [(s, i) for i, s in size.items() if s < least]
    heapq.heapify(heap)
    while heap:
        s, i = heapq.heappop(heap)
        if size.get(i) != s or not near[i]:
            continue
        j = min(near[i], key=lambda n: (-near[i][n], size[n], n))
        to, gone = min(i, j), max(i, j)
        size[to] = size[i] + size[j]
        del size[gone]
        region[gone] = to
        for n, length in near.pop(gone).items():
            del near[n][gone]
            if n != to:
                near[to][n] = near[to].get(n, 0.0) + length
                near[n][to] = near[to][n]
        if size[to] < least:
            heapq.heappush(heap, (size[to], to))

    def root(i):
        while region[i] != i:
            region[i] = region[region[i]]
            i = region[i]
        return i

    return pd.DataFrame({"id": group.id, "region": [root(i) for i in group.id]})


def merge_small(units: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """(id, region) of ``units(id, zone, size)``, a null size counting as 0; merges never leave a zone, which is one task's
    group.  ``edges(a, b, len)`` in both directions."""
    sides = edges.groupBy(F.col("a").alias("id")).agg(F.collect_list(F.struct("b", "len")).alias("sides"))
    rows = units.select("id", "zone", F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size")).join(sides, "id", "left")
    return rows.groupBy("zone").applyInPandas(lambda g: merge_group(g.drop(columns="zone"), least), "id long, region long")


def kmeans(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """(id, label): k-means of log(1 + x), standardised; labels from 1.  Rows with a null or a
    negative value get no label."""
    logs = [f"_log_{c}" for c in columns]
    rows = df.select("id", *(F.when(F.col(c) >= 0, F.log1p(c)).alias(n) for c, n in zip(columns, logs, strict=True)))
    rows = cut(rows)
    steps = [VectorAssembler(inputCols=logs, outputCol="_v", handleInvalid="skip"), StandardScaler(inputCol="_v", outputCol="_s", withMean=True), KMeans(k=k, seed=seed, featuresCol="_s", predictionCol="_p", maxIter=300)]
    return rows.select("id").join(Pipeline(stages=steps).fit(rows).transform(rows).select("id", (F.col("_p") + 1).alias("label")), "id", "left")
