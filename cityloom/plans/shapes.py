"""Queries of polygons: L shapes (a footprint without its upper right quarter), bow ties and
rings with a hole, whose measures SQL has in closed form."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import polygons as pg
from cityloom.operators import overlay
from cityloom.plans.places import _AREA, _MEET
from cityloom.plans.register import query, r6
from cityloom.sources.layers import layer

_W, _H = "(x1 - x0)", "(y1 - y0)"
#: Area of a disc of radius 1 with 8 segments to a right angle.
_DISC = 16 * math.sin(math.pi / 16)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints as L shapes."""
    f = layer(spark, sf_dir, "footprints")
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    ell = overlay.ring(("x0", "y0"), ("x1", "y0"), ("x1", my), (mx, my), (mx, "y1"), ("x0", "y1"))
    return f.select("id", "src", "area", F.array(ell).alias("geom"))


def rects(df: DataFrame) -> DataFrame:
    return df.withColumn("geom", F.array(overlay.ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects(layer(spark, sf_dir, "units")).select("unit_id", "zone", "geom")


_QUARTER = _AREA.replace("a.x0", "(a.x0 + a.x1) / 2").replace("a.y0", "(a.y0 + a.y1) / 2").replace("(least(", "greatest(0, least(", 1).replace(") * (least(", ") * greatest(0, least(")
_ELL = f"({_AREA} - {_QUARTER})"
_INTER = f"SELECT a.id, b.unit_id, b.zone, {_ELL} AS area FROM footprints a JOIN units b ON {_MEET} WHERE {_ELL} > 1e-9"


@query(f"SELECT id, unit_id, round(area, 4) AS area FROM ({_INTER})")
def g_intersection_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = overlay.intersect(shapes(spark, sf_dir), tiles(spark, sf_dir), ["a_id", "b_unit_id"])
    return got.select(F.col("a_id").alias("id"), F.col("b_unit_id").alias("unit_id"), F.round("area", 4).alias("area"))


@query(f"SELECT zone, src, count(*) AS pieces, round(sum(area), 3) AS area FROM (SELECT i.*, f.src FROM ({_INTER}) i JOIN footprints f USING (id)) GROUP BY zone, src")
def g_overlay_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces with the attributes of both layers, measured again on their outlines."""
    got = overlay.intersect(shapes(spark, sf_dir), tiles(spark, sf_dir), ["a_id", "a_src", "b_zone"])
    measured = overlay.each(got.select(F.col("a_src").alias("src"), F.col("b_zone").alias("zone"), "piece"), "piece", lambda p: {"area": sum(map(pg.ring_area, p))}, "area double")
    return measured.groupBy("zone", "src").agg(F.count("*").alias("pieces"), F.round(F.sum("area"), 3).alias("area"))


@query(f"SELECT id, unit_id, round(2500 - area, 4) AS area FROM ({_INTER})")
def g_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each unit has besides a building that reaches into it."""
    got = overlay.intersect(tiles(spark, sf_dir), shapes(spark, sf_dir), ["a_unit_id", "b_id"], op="less").where("area < 2500 - 1e-9")
    return got.select(F.col("b_id").alias("id"), F.col("a_unit_id").alias("unit_id"), F.round("area", 4).alias("area"))


@query("SELECT id, area, 2 * (x1 - x0 + y1 - y0) AS perimeter, CAST(1 AS INT) AS parts FROM footprints")
def g_dissolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each L shape united with the quarter that it lacks: sides that both have vanish."""
    f = layer(spark, sf_dir, "footprints")
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    quarter = f.select("id", F.array(overlay.ring((mx, my), ("x1", my), ("x1", "y1"), (mx, "y1"))).alias("geom"))
    united = overlay.dissolve(shapes(spark, sf_dir).select("id", "geom").unionByName(quarter), "id")
    out = overlay.each(united, "geom", lambda p: {"area": sum(map(pg.ring_area, p)), "perimeter": pg.perimeter(p), "parts": len(p)}, "area double, perimeter double, parts int")
    return out.select("id", r6("area").alias("area"), r6("perimeter").alias("perimeter"), "parts")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects(layer(spark, sf_dir, "footprints")).select("id", "geom")


@query(f"SELECT id, round(area + 2 * ({_W} + {_H}) * 3 + {_DISC!r} * 9, 4) AS area FROM footprints")
def g_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints grown by 3 m with round corners."""
    return overlay.each(footprints(spark, sf_dir), "geom", lambda p: {"area": round(pg.area(pg.buffer(p, 3.0)), 4)}, "area double")


@query(f"SELECT id, CASE WHEN least({_W}, {_H}) <= 10 THEN 0 ELSE round(area - (4 - {_DISC!r}) * 25, 3) END AS area FROM footprints")
def g_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints shrunk and grown by 5 m: narrow ones go, others get round corners."""
    return overlay.each(footprints(spark, sf_dir), "geom", lambda p: {"area": round(pg.area(pg.opened(p, 5.0)), 3)}, "area double")


@query("SELECT id, TRUE AS inside FROM footprints")
def g_point_on_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of each L shape, tested by the ray that runs from it to the right."""

    def test(p: pg.Polygon) -> dict:
        x, y = pg.inner_point(pg.overlay([p], lambda s: s[0]))
        a, b = p[0], np.roll(p[0], -1, axis=0)
        on = (a[:, 1] > y) != (b[:, 1] > y)
        at = a[on, 0] + (y - a[on, 1]) * (b[on, 0] - a[on, 0]) / (b[on, 1] - a[on, 1])
        return {"inside": bool((at > x).sum() % 2)}

    return overlay.each(shapes(spark, sf_dir).select("id", "geom"), "geom", test, "inside boolean")


@query(f"SELECT id, {_W} * {_H} / 2 AS area, CAST(2 AS INT) AS parts FROM footprints WHERE {_W} * {_H} / 2 >= 40")
def g_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow ties made valid, as two triangles; those under 40 m2 go."""
    tie = F.array(overlay.ring(("x0", "y0"), ("x1", "y1"), ("x1", "y0"), ("x0", "y1")))

    def fix(p: pg.Polygon) -> dict:
        q = pg.clean(p, 40.0)
        return {"area": None if q is None else round(sum(map(pg.ring_area, q)), 6), "parts": None if q is None else len(q)}

    return overlay.each(layer(spark, sf_dir, "footprints").select("id", tie.alias("geom")), "geom", fix, "area double, parts int").where("area is not null")


@query(f"SELECT id, area - 4 AS holed, area AS filled, CASE WHEN area >= 200 THEN 1 ELSE 0 END::INT AS large FROM footprints WHERE {_W} > 4 AND {_H} > 4")
def g_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with a hole of 4 m2: their area, that without the hole, and parts of 200 m2 or more."""
    x, y = F.col("x0"), F.col("y0")
    outer = overlay.ring(("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))
    hole = overlay.ring((x + 1, y + 1), (x + 1, y + 3), (x + 3, y + 3), (x + 3, y + 1))

    def measure(p: pg.Polygon) -> dict:
        valid = pg.rings(pg.overlay([p], lambda s: s[0]))
        full = pg.without_holes(valid)
        return {"holed": round(sum(map(pg.ring_area, valid)), 6), "filled": round(sum(map(pg.ring_area, full)), 6), "large": len(pg.without_small_parts(full, 200.0))}

    return overlay.each(layer(spark, sf_dir, "footprints").where("x1 - x0 > 4 AND y1 - y0 > 4").select("id", F.array(outer, hole).alias("geom")), "geom", measure, "holed double, filled double, large int")


@query(f"SELECT id, CAST(4 AS INT) AS simple, CAST(2 * ceil({_W} / 5) + 2 * ceil({_H} / 5) AS INT) AS dense, round(x0 / 10) * 10 AS snapped FROM footprints")
def g_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners after thinning of a densified ring, corners of that ring, and a rounded coordinate."""

    def measure(p: pg.Polygon) -> dict:
        dense = pg.segmentize(p[0], 5.0)
        return {"simple": len(pg.simplify(dense, 0.01)), "dense": len(dense)}

    f = layer(spark, sf_dir, "footprints")
    out = overlay.each(rects(f).select("id", "x0", "geom"), "geom", measure, "simple int, dense int")
    return out.select("id", "simple", "dense", (F.round(F.col("x0") / 10) * 10).alias("snapped"))


@query(None)
def g_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of building points, cut to 60 m around each; of points at one place the first has the cell."""
    p = layer(spark, sf_dir, "points").groupBy("x", "y").agg(F.min("id").alias("id"))
    return overlay.cells_of_points(p, 60.0).select("id", r6("area").alias("area"))


@query("SELECT id, CAST(CASE WHEN area / (3.141592653589793 * r * r) <= 0.375 AND area <= 275000 THEN 1 ELSE 0 END AS INT) AS artefact, area <= 70000 AS small FROM (SELECT id, area, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) / 2 AS r FROM footprints)")
def g_road_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow faces between roads: a small part of their least circle, and not large."""
    r2 = (F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2)) / 4
    ratio = F.col("area") / (F.pi() * r2)
    return layer(spark, sf_dir, "footprints").select("id", ((ratio <= 0.375) & (F.col("area") <= 275000)).cast("int").alias("artefact"), (F.col("area") <= 70000).alias("small"))
