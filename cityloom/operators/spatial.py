"""Spatial joins as equi joins on grid cells.

Both sides are spread over the cells that they touch; a pair is kept only in the cell
that holds the lower corner of its overlap, so nothing has to be made distinct.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityloom.sources.scratch import cut


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(c).alias(prefix + c) for c in df.columns])


def _cells(df: DataFrame, p: str, size: float, margin: float = 0.0) -> DataFrame:
    at = lambda c, m: F.floor((F.col(p + c) + m) / size)
    df = df.withColumn("cx", F.explode(F.sequence(at("x0", -margin), at("x1", margin))))
    return df.withColumn("cy", F.explode(F.sequence(at("y0", -margin), at("y1", margin))))


def rect_pairs(a: DataFrame, b: DataFrame, size: float = 50.0) -> DataFrame:
    """Pairs of rectangles whose interiors meet, columns prefixed a_ and b_."""
    left, right = _cells(prefixed(a, "a_"), "a_", size), _cells(prefixed(b, "b_"), "b_", size)
    meet = (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    home = (F.col("cx") == F.floor(F.greatest("a_x0", "b_x0") / size)) & (F.col("cy") == F.floor(F.greatest("a_y0", "b_y0") / size))
    return left.join(right, ["cx", "cy"]).where(meet & home).drop("cx", "cy")


def points_in(points: DataFrame, rects: DataFrame, size: float = 50.0) -> DataFrame:
    """Points (half-open) inside rectangles: point columns, and rectangle columns prefixed b_."""
    at = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    inside = (F.col("x") >= F.col("b_x0")) & (F.col("x") < F.col("b_x1")) & (F.col("y") >= F.col("b_y0")) & (F.col("y") < F.col("b_y1"))
    return at.join(_cells(prefixed(rects, "b_"), "b_", size), ["cx", "cy"]).where(inside).drop("cx", "cy")


def first_by(df: DataFrame, key: str | list[str], *order) -> DataFrame:
    """The first row of each key; ``order`` has to end in a unique column."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def points_within(points: DataFrame, distance: float) -> DataFrame:
    """Ordered pairs of different points at most ``distance`` apart: a_, b_ and dist."""
    a = prefixed(points, "a_").withColumns({"cx": F.floor(F.col("a_x") / distance), "cy": F.floor(F.col("a_y") / distance)})
    b = prefixed(points, "b_")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = b.withColumn("dx", F.explode(near)).withColumn("dy", F.explode(near))
    b = b.select(*[c for c in b.columns if c[:2] == "b_"], (F.floor(F.col("b_x") / distance) + F.col("dx")).alias("cx"), (F.floor(F.col("b_y") / distance) + F.col("dy")).alias("cy"))
    d = F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), 2) + F.pow(F.col("a_y") - F.col("b_y"), 2))
    return a.join(b, ["cx", "cy"]).where(F.col("a_id") != F.col("b_id")).withColumn("dist", d).where(F.col("dist") <= distance).drop("cx", "cy")


def nearest(points: DataFrame, targets: DataFrame, k: int, reach: float) -> DataFrame:
    """The ``k`` nearest targets of each point, exactly: id, t_id, dist, rank (ties by t_id).

    A point is done once k targets lie within the reach; all others go on with twice the
    reach, until it spans both extents.  Both inputs have id, x, y."""
    box = lambda df: df.select("x", "y")
    e = box(points).unionAll(box(targets)).agg(*(f(c) for c in "xy" for f in (F.min, F.max))).first()
    if e[0] is None:
        e = (0.0, 0.0, 0.0, 0.0)
    span = math.hypot(e[1] - e[0], e[3] - e[2])
    left, found = points.select("id", "x", "y"), []
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        at = lambda c: F.floor(F.col(c) / reach)
        t = targets.select(F.col("id").alias("t_id"), F.col("x").alias("tx"), F.col("y").alias("ty")).withColumn("dx", F.explode(shift)).withColumn("dy", F.explode(shift))
        t = t.select("t_id", "tx", "ty", (at("tx") + F.col("dx")).alias("cx"), (at("ty") + F.col("dy")).alias("cy"))
        d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
        near = left.withColumns({"cx": at("x"), "cy": at("y")}).join(t, ["cx", "cy"]).select("id", "t_id", d.alias("dist")).where(F.col("dist") <= reach)
        top = near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "t_id"))).where(F.col("rank") <= k)
        if reach >= span:
            found.append(top)
            return reduce(DataFrame.unionAll, found)
        top = cut(top)
        done = top.where(F.col("rank") == k).select("id")
        found.append(top.join(done, "id", "left_semi"))
        left = cut(left.join(done, "id", "left_anti"))
        if left.isEmpty():
            return reduce(DataFrame.unionAll, found)
        reach *= 2


def lines_in(lines: DataFrame, rects: DataFrame, size: float = 50.0) -> DataFrame:
    """Level lines (x0, x1, y) clipped to rectangles: line columns, b_ columns and ``len``."""
    at = lines.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))).withColumn("cy", F.floor(F.col("y") / size))
    from_ = F.greatest("x0", "b_x0")
    meet = (F.col("x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("x1")) & (F.col("y") >= F.col("b_y0")) & (F.col("y") < F.col("b_y1")) & (F.col("cx") == F.floor(from_ / size))
    return at.join(_cells(prefixed(rects, "b_"), "b_", size), ["cx", "cy"]).where(meet).withColumn("len", F.least("x1", "b_x1") - from_).drop("cx", "cy")


def hex_grid(spark: SparkSession, width: float, height: float, area: float) -> DataFrame:
    """Centres (i, j, x, y) of flat hexagons of an area that cover an extent from the origin."""
    side = math.sqrt(2 * area / (3 * math.sqrt(3)))
    dx, dy = 1.5 * side, math.sqrt(3) * side
    i, j = (F.explode(F.sequence(F.lit(0), F.lit(math.ceil(m / s)))) for m, s in ((width, dx), (height, dy)))
    return spark.range(1).select(i.alias("i")).select("i", j.alias("j")).select("i", "j", (F.col("i") * dx).alias("x"), ((F.col("j") + F.col("i") % 2 / 2) * dy).alias("y"))
