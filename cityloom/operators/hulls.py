"""Convex hulls of groups of points, and the shapes that follow from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hull(xy: np.ndarray) -> np.ndarray:
    """The corners of the convex hull against the clock, from the least x; no point inside a side."""
    p = sorted(set(map(tuple, xy.tolist())))
    if len(p) < 3:
        return np.array(p, float).reshape(-1, 2)

    def chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def area(h: np.ndarray) -> float:
    if len(h) < 3:
        return 0.0
    n = np.roll(h, -1, axis=0)
    return float((h[:, 0] * n[:, 1] - n[:, 0] * h[:, 1]).sum() / 2)


def least_rectangle(h: np.ndarray) -> tuple[float, float]:
    """Length and width of the rectangle of least area, which lies along a side of the hull."""
    if len(h) < 3:
        return float(np.hypot(*(h[-1] - h[0]))), 0.0
    d = np.roll(h, -1, axis=0) - h
    u = d / np.hypot(d[:, 0], d[:, 1])[:, None]
    along, across = np.ptp(u @ h.T, axis=1), np.ptp(np.stack([-u[:, 1], u[:, 0]], axis=1) @ h.T, axis=1)
    k = int(np.argmin(along * across))
    return max(along[k], across[k]), min(along[k], across[k])


def least_circle(h: np.ndarray) -> float:
    """Radius of the smallest circle around the corners of a hull, grown point by point."""

    def two(a: list[float], b: list[float]) -> tuple[float, float, float]:
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.hypot(a[0] - b[0], a[1] - b[1]) / 2

    def three(a: list[float], b: list[float], c: list[float]) -> tuple[float, float, float]:
        bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-12:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda t: t[2])
        u, v = bx * bx + by * by, cx * cx + cy * cy
        x, y = (cy * u - by * v) / d, (bx * v - cx * u) / d
        return a[0] + x, a[1] + y, math.hypot(x, y)

    p = h.tolist()
    out = lambda o, q: math.hypot(q[0] - o[0], q[1] - o[1]) > o[2] * (1 + 1e-12) + 1e-12
    o = (p[0][0], p[0][1], 0.0)
    for i in range(1, len(p)):
        if out(o, p[i]):
            o = (p[i][0], p[i][1], 0.0)
            for j in range(i):
                if out(o, p[j]):
                    o = two(p[i], p[j])
                    for k in range(j):
                        if out(o, p[k]):
                            o = three(p[i], p[j], p[k])
    return o[2]


def group_shapes(points: DataFrame) -> DataFrame:
    """key, corners, area, length, width and reock (area by that of the least circle, null without
    one) of ``points(key, x, y)``.  Points with a null belong to no shape.

    Batches are reduced to hulls first, so a group's task gets corners only, however many
    points the group has; many small groups share a batch."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            number, keys = pd.factorize(b["key"])
            order = np.argsort(number, kind="stable")
            xy = b[["x", "y"]].to_numpy(float)[order]
            stops = np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(keys)))))
            found = [hull(xy[i:j]) for i, j in zip(stops[:-1], stops[1:], strict=True)]
            if found:
                xy = np.concatenate(found)
                yield pd.DataFrame({"key": keys.repeat([len(h) for h in found]), "x": xy[:, 0], "y": xy[:, 1]})

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("corners")
            flat = lists.flatten()
            xy = np.stack([flat.field("x").to_numpy(), flat.field("y").to_numpy()], axis=1)
            stops = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            rows = []
            for i, j in zip(stops[:-1], stops[1:], strict=True):
                h = hull(xy[i:j])
                r, a = least_circle(h), area(h)
                rows.append((len(h), a, *least_rectangle(h), a / (np.pi * r * r) if r else None))
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(list(c), k) for c, k in zip(columns, [pa.int64()] + [pa.float64()] * 4, strict=True))], ["key", "corners", "area", "length", "width", "reock"])

    kind = points.schema["key"].dataType.simpleString()
    known = points.select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    corners = known.mapInPandas(partial, f"key {kind}, x double, y double")
    groups = corners.groupBy("key").agg(F.collect_list(F.struct("x", "y")).alias("corners"))
    return groups.mapInArrow(shapes, f"key {kind}, corners long, area double, length double, width double, reock double")
