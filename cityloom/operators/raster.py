"""Rasters in long form: (band, r, c, v); a masked cell has no row or a null value."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.operators.graph import components
from cityloom.sources.scratch import cut


def block_mean(cells: DataFrame, factor: int) -> DataFrame:
    return cells.groupBy("band", F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg("v").alias("v"), F.max("v").alias("top"))


def focal_sum(cells: DataFrame, reach: int) -> DataFrame:
    """Sum and count over a square of 2 * reach + 1 cells; missing cells are skipped.  Each
    cell is sent to its neighbours and summed there: one shuffle, summed before it."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    far = cells.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    sums = far.groupBy("band", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).agg(F.sum("v").alias("total"), F.count("v").alias("n"))
    return sums.join(cells.select("band", "r", "c"), ["band", "r", "c"], "left_semi")


def presence_codes(cells: DataFrame, bands: list[str], over: float) -> DataFrame:
    """A bit for each band whose value is over the limit."""
    bits = [F.max(F.when((F.col("band") == b) & (F.col("v") > over), 1 << i).otherwise(0)) for i, b in enumerate(bands)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return cells.groupBy("r", "c").agg(total.cast("int").alias("code"))


def mosaic_first(cells: DataFrame, order: list[str]) -> DataFrame:
    """The first band in ``order`` that has a cell gives its value."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("band"))
    return cells.where("v is not null").groupBy("r", "c").agg(F.min_by("v", rank).alias("v"), F.min_by("band", rank).alias("band"))


def cell_rects(cells: DataFrame, size: float) -> DataFrame:
    """Cells with their rectangles x0, y0, x1, y1."""
    at = lambda c, k: (F.col(c) + k) * F.lit(float(size))
    return cells.withColumns({"x0": at("c", 0), "y0": at("r", 0), "x1": at("c", 1), "y1": at("r", 1)})


def rasterize(rects: DataFrame, size: float) -> DataFrame:
    """(r, c, touched, centred, last): rectangles that touch each cell's interior, those that
    hold its centre (half-open), and the largest id, which is the last writer."""
    along = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.ceil(F.col(hi) / size) - 1))
    at = rects.where("x0 < x1 AND y0 < y1").withColumn("c", along("x0", "x1")).withColumn("r", along("y0", "y1"))
    mid = lambda c: (F.col(c) + 0.5) * size
    centre = (mid("c") >= F.col("x0")) & (mid("c") < F.col("x1")) & (mid("r") >= F.col("y0")) & (mid("r") < F.col("y1"))
    return at.groupBy("r", "c").agg(F.count("*").alias("touched"), F.count_if(centre).alias("centred"), F.max("id").alias("last"))


def patches(cells: DataFrame, width: int) -> DataFrame:
    """(r, c, patch): 8-connected patches of the given cells of a raster ``width`` wide, named by
    their least cell number."""
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    own = cells.select((F.col("r") * width + F.col("c")).alias("id"), "r", "c").distinct()
    far = own.select(F.col("id").alias("a"), "r", F.explode(step).alias("dr"), "c").withColumn("dc", F.explode(step)).where("dr <> 0 OR dc <> 0")
    far = far.select("a", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"))
    edges = cut(far.join(own, ["r", "c"]).select("a", F.col("id").alias("b")))
    return own.join(components(own, edges), "id").select("r", "c", F.col("component").alias("patch"))


def tiles(spark: SparkSession, width: int, height: int, size: int, overlap: int) -> DataFrame:
    """(row, col, y, x): corners of tiles of a fixed size whose neighbours overlap."""
    step = size - overlap
    ids = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-(n - overlap) // step) - 1))))
    return spark.range(1).select(ids(height).alias("row")).select("row", ids(width).alias("col")).select("row", "col", (F.col("row") * step).alias("y"), (F.col("col") * step).alias("x"))


def circle(radius: float) -> list[tuple[int, int]]:
    """Offsets of the cells whose centres lie within a radius in cells."""
    n = int(radius)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j <= radius * radius]


def spread(cells: DataFrame, offsets: list[tuple[int, int]], keep: str | None = None) -> DataFrame:
    """Each cell at each offset from it, with its distance as ``keep`` if wanted: what follows
    groups by (r, c), summed before the one shuffle."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(math.hypot(i, j)).alias("d")) for i, j in offsets))
    far = cells.withColumn("_o", F.explode(steps)).withColumns({"r": F.col("r") + F.col("_o.i"), "c": F.col("c") + F.col("_o.j")})
    return (far.withColumn(keep, F.col("_o.d")) if keep else far).drop("_o")


def resample_nearest(cells: DataFrame, size: int, to: int) -> DataFrame:
    """Cells of size ``to`` with the value under their centre.  Each cell is sent to the new
    cells whose centre it holds: no join."""
    half = to / 2
    at = lambda c: F.sequence(F.ceil((F.col(c) * size - half) / to), F.ceil((F.col(c) * size + size - half) / to) - 1)
    some = cells.where(f"ceil((c * {size} + {size} - {half}) / {to}) > ceil((c * {size} - {half}) / {to}) AND ceil((r * {size} + {size} - {half}) / {to}) > ceil((r * {size} - {half}) / {to})")
    return some.withColumn("tr", F.explode(at("r"))).withColumn("tc", F.explode(at("c"))).select("band", F.col("tr").alias("r"), F.col("tc").alias("c"), "v")


def resample_average(cells: DataFrame, size: int, to: int) -> DataFrame:
    """Cells of size ``to`` with the mean by shared area, and the share that is known."""
    at = lambda c: F.explode(F.sequence(F.floor(F.col(c) * size / to), F.ceil((F.col(c) + 1) * size / to) - 1))
    part = cells.withColumn("tr", at("r")).withColumn("tc", at("c"))
    over = lambda c, t: F.least((F.col(c) + 1) * size, (F.col(t) + 1) * to) - F.greatest(F.col(c) * size, F.col(t) * to)
    w = over("r", "tr") * over("c", "tc")
    per = part.withColumn("w", w).groupBy("band", "tr", "tc").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"), (F.sum("w") / (to * to)).alias("known"))
    return per.select("band", F.col("tr").alias("r"), F.col("tc").alias("c"), "v", "known")


def sample_bilinear(cells: DataFrame, points: DataFrame, size: int) -> DataFrame:
    """(id, v): the value at each point between the four cell centres around it."""
    fx, fy = F.col("x") / size - 0.5, F.col("y") / size - 0.5
    step = F.array(F.lit(0), F.lit(1))
    p = points.select("id", fx.alias("fx"), fy.alias("fy")).withColumn("i", F.explode(step)).withColumn("j", F.explode(step))
    p = p.withColumns({"c": F.floor("fx") + F.col("i"), "r": F.floor("fy") + F.col("j")})
    w = (1 - F.abs(F.col("fx") - F.col("c"))) * (1 - F.abs(F.col("fy") - F.col("r")))
    return p.join(cells.select("r", "c", "v"), ["r", "c"]).withColumn("w", w).where("w > 0").groupBy("id").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def polygonize(patches: DataFrame, size: float) -> DataFrame:
    """(patch, rings): the outlines of patches as closed rings, outer ones counter-clockwise and
    holes clockwise.  Sides that two cells of a patch share cancel before any patch is put
    together, so a task sees outlines only."""
    side = lambda r0, c0, r1, c1: F.struct(*((F.col(k) + d).cast("long").alias(n) for k, d, n in (("r", r0, "ra"), ("c", c0, "ca"), ("r", r1, "rb"), ("c", c1, "cb"))))
    sides = patches.select("patch", F.inline(F.array(side(0, 0, 0, 1), side(0, 1, 1, 1), side(1, 1, 1, 0), side(1, 0, 0, 0))))
    end = lambda k: F.struct(F.col("r" + k).alias("r"), F.col("c" + k).alias("c"))
    same = [F.least(end("a"), end("b")).alias("p"), F.greatest(end("a"), end("b")).alias("q")]
    outline = sides.groupBy("patch", *same).agg(F.count("*").alias("n"), *(F.first(k).alias(k) for k in ("ra", "ca", "rb", "cb"))).where("n = 1")

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for a, b, c, d in rows[["ra", "ca", "rb", "cb"]].sort_values(["ra", "ca", "rb", "cb"]).itertuples(index=False, name=None):
            out.setdefault((a, b), []).append((c, d))
        rings = []
        while out:
            start = at = min(out)
            ring, came = [], None
            while True:
                choice = out[at]
                # Where two corners meet, the turn to the left keeps the rings apart.
                turn = lambda n: (n[1] - at[1]) * (at[0] - came[0]) - (n[0] - at[0]) * (at[1] - came[1]) if came else 0  # noqa: B023, E731
                to = min(choice, key=turn)
                choice.remove(to)
                if not choice:
                    del out[at]
                ring.append((at[1] * size, at[0] * size))
                came, at = at, to
                if at == start:
                    break
            rings.append([{"x": float(x), "y": float(y)} for x, y in ring])
        return pd.DataFrame({"patch": [rows["patch"].iloc[0]], "rings": [rings]})

    return outline.groupBy("patch").applyInPandas(assemble, "patch long, rings array<array<struct<x: double, y: double>>>")


def measure_rings(polygons: DataFrame) -> DataFrame:
    """(patch, area, perimeter) of closed rings; holes, which run clockwise, count against the area."""
    step = lambda r, f: F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0), lambda s, i: s + f(F.get(r, i), F.get(r, (i + 1) % F.size(r))))
    cross = lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2
    length = lambda a, b: F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))
    total = lambda f: F.aggregate("rings", F.lit(0.0), lambda s, r: s + step(r, f))
    return polygons.select("patch", total(cross).alias("area"), total(length).alias("perimeter"))
