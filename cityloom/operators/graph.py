"""Greedy and graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.sources.scratch import cut


def recency_suppress(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keep nodes in the order of ``pos`` unless a kept one conflicts: (id, kept, blocker).

    The greedy result is the lexicographically first maximal independent set.  Each
    round keeps every undecided node that no undecided neighbour precedes, and drops
    the neighbours of kept ones.  ``nodes(id, pos)`` with distinct pos, ``edges(a, b)``
    in both directions."""
    e = edges.join(nodes.select(F.col("id").alias("a"), F.col("pos").alias("pa")), "a").join(nodes.select(F.col("id").alias("b"), F.col("pos").alias("pb")), "b")
    before = cut(e.where("pb < pa").select("a", "b", "pb"))
    state = cut(nodes.select("id", F.lit(None).cast("boolean").alias("kept")))
    while True:  # the first undecided node is decided in each round
        near = before.join(state.select(F.col("id").alias("b"), F.col("kept").alias("kb")), "b")
        seen = near.groupBy(F.col("a").alias("id")).agg(F.bool_or(F.coalesce("kb", F.lit(False))).alias("hit"), F.bool_or(F.col("kb").isNull()).alias("open"))
        now = state.join(seen, "id", "left")
        state = cut(now.select("id", F.coalesce("kept", F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)).alias("kept")))
        if state.where("kept is null").isEmpty():
            break
    blocker = before.join(state.where("kept").select(F.col("id").alias("b")), "b").groupBy(F.col("a").alias("id")).agg(F.min_by("b", "pb").alias("blocker"))
    return state.join(blocker, "id", "left").select("id", "kept", F.when(~F.col("kept"), F.col("blocker")).alias("blocker"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that edges lead to.  ``edges(a, b)`` in both directions.

    Each round takes the least label among the neighbours, then the label of the node that
    the label names, so long chains shorten by halves."""
    state = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = edges.join(state.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        step = state.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "least").alias("to"))
        jump = state.select(F.col("id").alias("to"), F.col("component").alias("far"))
        now = cut(step.join(jump, "to").select("id", "old", F.least("to", "far").alias("component")))
        state = now.select("id", "component")
        if now.where("component < old").isEmpty():
            return state


def neighbour_shares(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, share): shares of labels among the neighbours; ``nodes(id, label)``."""
    own = edges.join(nodes.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id"), "label").agg(F.count("*").alias("c"))
    return own.select("id", "label", (F.col("c") / F.sum("c").over(Window.partitionBy("id"))).alias("share"))


def hot_spots(nodes: DataFrame, edges: DataFrame, value: Column) -> DataFrame:
    """(id, z, bin): the Gi* score of each node's value and its neighbours' against all nodes,
    and the bin -3..3 by 90, 95 and 99 per cent."""
    x = nodes.select("id", value.cast("double").alias("x"))
    all_ = x.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    star = edges.select("a", "b").unionAll(nodes.select(F.col("id").alias("a"), F.col("id").alias("b")))
    local = star.join(x.select(F.col("id").alias("b"), "x"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("x").alias("t"), F.count("x").alias("w"))
    spread = F.col("s") * F.sqrt((F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1))
    z = local.join(F.broadcast(all_)).select("id", F.try_divide(F.col("t") - F.col("m") * F.col("w"), spread).alias("z"))  # one row is sent
    size = F.when(F.abs("z") > 2.576, 3).when(F.abs("z") > 1.96, 2).when(F.abs("z") > 1.645, 1).otherwise(0)
    return z.select("id", "z", (size * F.signum("z")).cast("int").alias("bin"))
