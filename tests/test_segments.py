"""Polygon kernels against sampled points, and segment algorithms against their invariants."""

import random
import time

import numpy as np
import pandas as pd

from cityloom.functions import polygons as pg
from cityloom.operators import joins, overlay, raster, segments
import pytest


def inside(polygon, x, y):
    odd = np.zeros(x.shape, bool)
    for ring in polygon:
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if y0 != y1:
                odd ^= ((y0 > y) != (y1 > y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
    return odd


def test_overlays_equal_sampled_points():
    rng = np.random.default_rng(1)
    g = (np.arange(500) + 0.5) / 50
    x, y = np.meshgrid(g, g)
    for _ in range(6):
        a, b = [rng.random((7, 2)) * 10], [rng.random((5, 2)) * 10, rng.random((4, 2)) * 10]
        in_a, in_b = inside(a, x, y), inside(b, x, y)
        for t, want in ((pg.both(a, b), in_a & in_b), (pg.less(a, b), in_a & ~in_b), (pg.union([a, b]), in_a | in_b)):
            assert abs(pg.area(t) - want.mean() * 100) < 0.15
            assert abs(sum(map(pg.ring_area, pg.rings(t))) - pg.area(t)) < 1e-3
            p = pg.inner_point(t)
            assert p is None or inside(pg.rings(t), np.array([p[0]]), np.array([p[1]]))[0]


def test_buffers_holes_and_precision():
    square = pg.box(0, 0, 10, 10)
    gap = pg.closed([square[0], pg.box(11, 0, 20, 10)[0]], 1)
    assert len(pg.rings(gap)) == 1 and pg.area(gap) > 199
    assert pg.area(pg.buffer(square, -6)) == 0 and pg.clean(None) is None and pg.clean([np.array([(0, 0), (1, 0), (1, 1.0)])]) is None
    assert len(pg.set_precision(np.array([(0.01, 0), (0.02, 0), (1, 0), (1, 1.0)]), 0.1)) == 3
    ring = pg.segmentize(square[0], 3.0)
    assert len(ring) == 16 and len(pg.simplify(ring, 0.01)) == 4
    half = pg.clip_half(square[0], 5, 5, 1, 0)
    assert pg.ring_area(half) == 50


def test_convex_polygons_are_buffered_as_any_others():
    rng = np.random.default_rng(5)
    shapes = [pg.box(3, 4, 20, 11), [pg.box(0, 0, 30, 12)[0][::-1]], [pg.hull(rng.random((12, 2)) * 40)], [np.array([(0, 0), (30, 2), (9, 25.0)])]]
    for p in shapes:
        assert pg.convex(p) is not None
        far = [*p, np.array([(500, 500), (501, 500), (500.5, 501)])]  # a second part: not convex any more
        for d in (3.0, -2.0):
            assert abs(pg.area(pg.buffer(far, d)) - pg.area(pg.buffer(far[1:], d)) - pg.area(pg.buffer(p, d))) < 1e-5
        a, b, c = (pg.area(pg.opened(q, 2.0)) for q in (far, far[1:], p))
        assert abs(a - b - c) < 1e-3
    star = np.array([(np.cos(t), np.sin(t)) for t in 4 * np.pi / 5 * np.arange(5)])
    assert pg.convex([star]) is None and pg.convex([np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4.0)])]) is None


def test_buffers_of_many_rectangles_take_a_moment():
    began = time.process_time()
    for k in range(400):
        pg.buffer(pg.box(k, 0, k + 20, 9), 3.0), pg.opened(pg.box(k, 0, k + 20, 19), 5.0)
    assert time.process_time() - began < 3


def test_dissolve_in_groups_of_groups(spark, monkeypatch):
    monkeypatch.setattr(overlay, "_FAN", 3)
    rows = [(i % 2, [[{"x": x + i % 2 * 50.0, "y": y} for x, y in ((i, 0.0), (i + 2.0, 0.0), (i + 2.0, 1.0), (i, 1.0))]]) for i in range(20)]
    got = {r["k"]: r["geom"] for r in overlay.dissolve(spark.createDataFrame(rows, f"k long, geom {overlay.RINGS}"), "k").collect()}
    assert {k: (len(v), sum(map(pg.ring_area, overlay.to_polygon(v)))) for k, v in got.items()} == {0: (1, 20.0), 1: (1, 20.0)}


def test_voronoi_cells_by_nearest_points(spark):
    rng = random.Random(3)
    points = [(i, rng.random() * 100, rng.random() * 100) for i in range(60)]
    got = overlay.cells_of_points(spark.createDataFrame(points, "id long, x double, y double"), 20.0).collect()
    p = np.array([q[1:] for q in points])
    sample = np.random.default_rng(2).random((4000, 2)) * 100
    d = np.abs(sample[:, None, :] - p[None, :, :])
    who = np.hypot(*d.transpose(2, 0, 1)).argmin(axis=1)
    for r in got:
        hit = inside(overlay.to_polygon(r["geom"]), sample[:, 0], sample[:, 1])
        assert (who[hit] == r["id"]).all()
        near = (who == r["id"]) & (d[:, r["id"]].max(axis=1) < 20)
        assert hit[near].all()


def test_voronoi_cells_equal_those_of_all_bisectors():
    rng = np.random.default_rng(8)
    for p in (rng.random((150, 2)) * 400, rng.integers(0, 12, (60, 2)) * 10.0, np.zeros((3, 2)), rng.random((90, 2)) * 3):
        for block in (200, 2_000_000):
            for (x, y), got in zip(p, pg.cells(p, p, 60.0, block), strict=True):
                r = pg.box(x - 60, y - 60, x + 60, y + 60)[0]
                for u, v in p:
                    if (u, v) != (x, y):
                        r = pg.clip_half(r, (x + u) / 2, (y + v) / 2, u - x, v - y)
                assert abs(pg.ring_area(r) - pg.ring_area(got)) < 1e-6


def test_voronoi_cells_of_many_points_take_a_moment(spark):
    p = np.random.default_rng(9).random((4000, 2)) * 1400
    began = time.process_time()
    assert abs(sum(map(pg.ring_area, pg.cells(p, p, 60.0))) - 1460**2) < 1460**2 * 0.1
    assert time.process_time() - began < 5
    lost = overlay.cells_of_points(spark.createDataFrame([(1, 0.0, None), (2, 5.0, 5.0)], "id long, x double, y double"), 60.0)
    assert {(r["id"], r["area"]) for r in lost.collect()} == {(1, None), (2, 14400.0)}


def grid(n, seed):
    rng = random.Random(seed)
    ids = list(range(n * n))
    near = {i: {} for i in ids}
    for i in ids:
        for j in ((i + 1) if (i + 1) % n else None, i + n if i + n < n * n else None):
            if j is not None:
                near[i][j] = near[j][i] = 50.0
    frame = pd.DataFrame({"id": ids, "people": [float(rng.randrange(20, 220)) for _ in ids], "area": 2500.0, "perimeter": 200.0, "count": [float(rng.randrange(0, 9)) for _ in ids], "built": [float(rng.randrange(0, 900)) for _ in ids]})
    return frame, near


def connected(group, near):
    seen, todo = set(), [min(group)]
    while todo:
        k = todo.pop()
        if k not in seen:
            seen.add(k)
            todo += [m for m in near[k] if m in group]
    return len(seen) == len(group)


def test_region_merge_keeps_people_and_reruns_agree(spark):
    for seed in range(4):
        frame, near = grid(8, seed)
        region, key = segments.merge_run(frame, near, 102)
        assert (region, key) == segments.merge_run(frame.sample(frac=1, random_state=1).sort_values("id", ignore_index=True), near, 102)
        groups = {}
        for i, r in region.items():
            groups.setdefault(r, set()).add(i)
        people = frame.set_index("id").people
        assert all(connected(g, near) and min(g) == r for r, g in groups.items())
        assert key[0] == sum(people[list(g)].sum() < segments.LEAST for g in groups.values()) and len(groups) > 3
    frame, near = grid(6, 9)
    units = spark.createDataFrame(pd.concat([frame.assign(zone=1), frame.assign(zone=2, id=frame.id + 100)]))
    edges = spark.createDataFrame([(a + k, b + k, w) for k in (0, 100) for a in near for b, w in near[a].items()], "a long, b long, len double")
    one = segments.region_merge(units.repartition(3), edges, (102, 103)).toPandas().sort_values("id")
    two = segments.region_merge(units.repartition(5), edges, (102, 103)).toPandas().sort_values("id")
    assert one.region.tolist() == two.region.tolist() and len(one) == 72
    best = min((segments.merge_run(frame, near, s)[1], s) for s in (102, 103))[1]
    assert one[one.zone == 1].set_index("id").region.to_dict() == segments.merge_run(frame, near, best)[0]


def test_spanning_trees_inside_zones(spark):
    frame, near = grid(5, 2)
    rng = random.Random(1)
    w = {(a, b): rng.random() for a in near for b in near[a] if a < b}
    part, kept = segments.kruskal(list(near), [(a, b, x) for (a, b), x in w.items()])
    assert set(part.values()) == {0} and len(kept) == 24
    units = spark.createDataFrame([(i, i // 10) for i in near], "id long, zone long")
    edges = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()] + [(b, a, x) for (a, b), x in w.items()], "a long, b long, w double")
    got = segments.zone_trees(units.repartition(3), edges).collect()
    for zone in (0, 1, 2):
        ids = [i for i in near if i // 10 == zone]
        part, kept = segments.kruskal(ids, [(a, b, x) for (a, b), x in w.items() if a // 10 == b // 10 == zone])
        rows = [r for r in got if r["id"] in part]
        assert {r["id"]: r["component"] for r in rows} == part
        assert sorted((r["id"], t["b"], t["s"]) for r in rows for t in r["tree"]) == sorted(kept)


def test_tree_cuts():
    nodes = list(range(10))
    edges = [(i, i + 1, 1.0 if i != 3 else 5.0) for i in range(9)]
    parts = segments.tree_split(nodes, edges, {i: (150_000.0, 100.0) for i in nodes})
    assert sorted(sum(parts, [])) == nodes and [0, 1, 2, 3] not in parts and all(len(p) <= 3 for p in parts)
    assert segments.tree_split(nodes, [], {i: (1e9, 1.0) for i in nodes}) == [nodes]
    line = segments.compact_split(nodes, edges, {i: (i * 300.0, 0.0, 90_000.0) for i in nodes})
    assert len(line) > 1 and sorted(sum(line, [])) == nodes
    disc = segments.compact_split([0, 1], [(0, 1, 1.0)], {0: (0, 0, 90_000.0), 1: (300.0, 0, 90_000.0)})
    assert disc == [[0, 1]]


def test_beam_split_keeps_shares_and_connection():
    frame, near = grid(6, 5)
    xyw = {i: (i % 6 * 50.0, i // 6 * 50.0, 1.0) for i in frame.id}
    for n, (low, high) in segments.SHARES.items():
        parts = segments.beam_split(list(frame.id), xyw, near, n)
        assert len(parts) == n and sorted(sum(parts, [])) == list(frame.id)
        assert all(connected(set(p), near) and low - 1e-9 <= len(p) / 36 <= high + 1e-9 for p in parts)
    assert segments.beam_split([0, 1], {0: (0, 0, 1.0), 1: (50, 0, 9.0)}, {0: {1: 50}, 1: {0: 50}}, 2) is None


def test_rings_of_patches_with_a_hole(spark):
    cells = [(1, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)] + [(2, 5, 5), (2, 6, 6)]
    rings = raster.polygonize(spark.createDataFrame(cells, "patch long, r long, c long"), 10.0)
    got = {r["patch"]: (r["area"], r["perimeter"]) for r in raster.measure_rings(rings).collect()}
    assert got == {1: (800.0, 160.0), 2: (200.0, 80.0)}


def test_joins_check_their_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k long, v string")
    b = spark.createDataFrame([(1, 2.0)], "k long, w double")
    assert joins.left_validated(a, b, ["k"]).count() == 3
    with pytest.raises(ValueError, match="right key repeats"):
        joins.left_validated(a, b.unionAll(b), ["k"])
    with pytest.raises(ValueError, match="left key repeats"):
        joins.left_validated(a, b, ["k"], "one_to_one")
