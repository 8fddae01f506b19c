"""Polygon operators on DataFrames.  A geometry is a column ``array<array<struct<x, y>>>`` of rings
(see ``functions.polygons``); candidates come from equi joins on grid cells of their boxes, and
exact overlays run on Arrow batches of such pairs, never on a whole group but to dissolve it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.functions import polygons as pg
from cityloom.operators import spatial

RINGS = "array<array<struct<x: double, y: double>>>"


def ring(*corners: tuple[Column | str, Column | str]) -> Column:
    c = lambda v: (F.col(v) if isinstance(v, str) else v).cast("double")
    return F.array(*(F.struct(c(x).alias("x"), c(y).alias("y")) for x, y in corners))


def to_polygon(value) -> pg.Polygon:  # noqa: ANN001
    return [] if value is None else [np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in value if r is not None and len(r)]


def from_polygon(polygon: pg.Polygon) -> list:
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in polygon]


def with_box(df: DataFrame, geom: str) -> DataFrame:
    """``df`` with x0, y0, x1, y1 of each geometry; rows without corners go."""
    flat = F.flatten(F.col(geom))
    at = lambda k: F.transform(flat, lambda p: p[k])
    return df.withColumns({"x0": F.array_min(at("x")), "y0": F.array_min(at("y")), "x1": F.array_max(at("x")), "y1": F.array_max(at("y"))}).where("x0 is not null")


def each(df: DataFrame, geom: str, f: Callable[[pg.Polygon], dict], schema: str) -> DataFrame:
    """``df`` without ``geom``, with what ``f`` says of each geometry (columns of ``schema``)."""
    names = [x.split(":")[0].split()[0].strip() for x in _fields(schema)]
    kept = [c for c in df.columns if c != geom]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [f(to_polygon(v)) for v in frame[geom]]
            out = frame[kept].copy()
            for n in names:
                out[n] = pd.Series([g[n] for g in got], index=frame.index, dtype=object)
            yield out

    before = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema if x.name in kept)
    # A small file has one task; what is done to each geometry takes many.
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, f"{before}, {schema}" if before else schema)


def _fields(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def pairs(a: DataFrame, b: DataFrame, geom: str = "geom", size: float = 50.0) -> DataFrame:
    """Pairs whose boxes meet, columns prefixed a_ and b_."""
    return spatial.rect_pairs(with_box(a, geom), with_box(b, geom), size)


def intersect(a: DataFrame, b: DataFrame, keep: list[str], op: str = "both", geom: str = "geom", size: float = 50.0) -> DataFrame:
    """For each pair whose boxes meet the columns ``keep`` (prefixed), the area that the two
    share (``op`` 'both') or that only the first has ('less'), and the piece as rings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = getattr(pg, op)
        for frame in frames:
            cut = [f(to_polygon(x), to_polygon(y)) for x, y in zip(frame[f"a_{geom}"], frame[f"b_{geom}"], strict=True)]
            out = frame[keep].copy()
            out["area"] = [pg.area(t) for t in cut]
            out["piece"] = pd.Series([from_polygon(pg.rings(t)) for t in cut], index=frame.index, dtype=object)
            yield out[out["area"] > 1e-9]

    p = pairs(a, b, geom, size).select(*keep, f"a_{geom}", f"b_{geom}")
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in p.schema if x.name in keep)
    return p.mapInPandas(run, f"{kinds}, area double, piece {RINGS}")


def dissolve(df: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """(key, geom): the union of each key's geometries.  Geometries are first united in groups
    of ``_FAN`` and these again, so that a task holds so many polygons at a time only."""
    kind = df.schema[key].dataType.simpleString()

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        t = pg.union([to_polygon(v) for v in rows["geom"]])
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "part": [rows["part"].iloc[0] // _FAN], "geom": [from_polygon(pg.rings(t))]})

    now = df.select(F.col(key).alias("key"), F.col(geom).alias("geom"))
    n = now.groupBy("key").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n")).first()[0] or 0
    now = now.join(n, "key").withColumn("part", F.pmod(F.xxhash64("geom"), F.ceil(F.col("n") / _FAN)).cast("long")).drop("n")
    parts = -(-most // _FAN)
    schema = f"key {kind}, part long, geom {RINGS}"
    while True:
        now = now.groupBy("key", "part").applyInPandas(unite, schema)
        if parts <= 1:
            return now.select(F.col("key").alias(key), "geom")
        parts = -(-parts // _FAN)


_FAN = 64


def cells_of_points(points: DataFrame, reach: float) -> DataFrame:
    """(id, area, geom): the Voronoi cell of each point, cut to a square of ``reach`` to each
    side, null for a point without a place.  Tiles of ten reaches with a margin of 2.9 are the
    groups; points farther away cannot cut a cell, so the result is exact."""
    size, margin = 10 * reach, 2.9 * reach
    at = lambda c, m: F.floor((F.col(c) + m) / size)
    known = points.where("x is not null AND y is not null").select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    along = lambda c: F.explode(F.sequence(at(c, -margin), at(c, margin)))
    tiled = known.withColumn("tx", along("x")).withColumn("ty", along("y"))
    tiled = tiled.withColumn("own", (F.col("tx") == at("x", 0)) & (F.col("ty") == at("y", 0)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["x", "y", "id"], ignore_index=True)
        own = frame["own"].to_numpy(bool)
        xy = frame[["x", "y"]].to_numpy(float)
        cells = pg.cells(xy[own], xy, reach)
        geom = pd.Series([from_polygon([c]) for c in cells], dtype=object)
        return pd.DataFrame({"id": frame["id"][own].reset_index(drop=True), "area": [pg.ring_area(c) if len(c) else 0.0 for c in cells], "geom": geom})

    schema = f"id {points.schema['id'].dataType.simpleString()}, area double, geom {RINGS}"
    lost = points.where("x is null OR y is null").select("id", F.lit(None).cast("double").alias("area"), F.lit(None).cast(RINGS).alias("geom"))
    return tiled.groupBy("tx", "ty").applyInPandas(run, schema).unionAll(lost)
