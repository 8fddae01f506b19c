"""Operators without SQL against plain loops, and formats as round trips."""

import math
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cityloom.operators import graph, hulls, partition, spatial
from cityloom.plans import catalog
from cityloom.sources import files
from cityloom.sources.scratch import cut

SF = "/root/testdata/sf0.001"


def find(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def random_graph(seed, n=40, share=0.08):
    rng = random.Random(seed)
    edges = [(a, b, float(rng.randrange(12))) for a in range(n) for b in range(a + 1, n) if rng.random() < share]
    return list(range(n)), edges


def test_spanning_forest_equals_kruskal(spark):
    nodes, edges = random_graph(1)
    parent, want = {n: n for n in nodes}, set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        x, y = find(parent, a), find(parent, b)
        if x != y:
            parent[x] = y
            want.add((a, b, w))
    got = partition.spanning_forest(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long, w double"))
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)
    assert partition.spanning_forest(spark.createDataFrame([], "id long"), spark.createDataFrame([], "a long, b long, w double")).isEmpty()


def test_spanning_forest_in_rounds_equals_that_of_one_task(spark):
    nodes, edges = random_graph(3, 60, 0.07)
    frames = spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "a long, b long, w double")
    whole, rounds = ({tuple(r) for r in partition.spanning_forest(*frames, most=m).collect()} for m in (1000, 0))
    assert whole == rounds and whole


def test_estimated_sizes_do_not_multiply_over_rounds(spark):
    df = spark.range(100)
    for _ in range(5):
        df = cut(df.join(df.withColumnRenamed("id", "other"), F.col("id") == F.col("other")).select("id"))
    assert int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1e6


def test_components_equal_union_find(spark):
    nodes, edges = random_graph(2, 60, 0.02)
    parent = {n: n for n in nodes}
    for a, b, _ in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    both = [(a, b) for a, b, _ in edges] + [(b, a) for a, b, _ in edges]
    got = graph.components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(both, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {n: find(parent, n) for n in nodes}
    chain = [(i, i + 1) for i in range(40)]
    got = graph.components(spark.range(41), spark.createDataFrame(chain + [(b, a) for a, b in chain], "a long, b long"))
    assert {r["component"] for r in got.collect()} == {0}


def test_merge_small_equals_the_plain_loop():
    for seed in range(8):
        nodes, edges = random_graph(seed, 25, 0.1)
        rng = random.Random(seed)
        size = {n: float(rng.randrange(0, 9)) for n in nodes}
        sides = {n: [] for n in nodes}
        for a, b, w in edges:
            sides[a].append({"b": b, "len": w + 1})
            sides[b].append({"b": a, "len": w + 1})
        got = partition.merge_group(pd.DataFrame({"id": nodes, "size": [size[n] for n in nodes], "sides": [sides[n] for n in nodes]}), 10.0)
        region = {n: n for n in nodes}
        while True:
            total = {r: sum(size[n] for n in nodes if region[n] == r) for r in set(region.values())}
            share = {r: {} for r in total}
            for a, b, w in edges:
                x, y = region[a], region[b]
                if x != y:
                    share[x][y] = share[y][x] = share[x].get(y, 0.0) + w + 1
            small = sorted((s, r) for r, s in total.items() if s < 10 and share[r])
            if not small:
                break
            i = small[0][1]
            j = min(share[i], key=lambda n: (-share[i][n], total[n], n))
            region = {n: min(i, j) if r in (i, j) else r for n, r in region.items()}
        assert dict(zip(got.id, got.region, strict=True)) == region


def test_regions_are_named_by_their_least_unit(spark):
    got = catalog.queries()["merge_small_units"](spark, SF).toPandas()
    assert got.id.is_unique and (got.groupby("region").id.min() == sorted(got.region.unique())).all()


def test_nearest_with_too_few_targets_ties_and_empty_tables(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0)], "id long, x double, y double")
    t = spark.createDataFrame([(7, 3.0, 4.0), (8, 4.0, 3.0)], "id long, x double, y double")
    got = {(r["id"], r["rank"]): (r["t_id"], r["dist"]) for r in spatial.nearest(p, t, 3, 1.0).collect()}
    assert got[(1, 1)] == (7, 5.0) and got[(1, 2)] == (8, 5.0) and len(got) == 4
    assert spatial.nearest(p, t.limit(0), 1, 1.0).isEmpty() and spatial.nearest(p.limit(0), t.limit(0), 1, 1.0).isEmpty()


def test_kmeans_splits_plain_groups_and_passes_nulls(spark):
    rows = [(i, float(i % 2 * 1000 + i % 5), 1.0) for i in range(60)] + [(99, None, 1.0)]
    got = partition.kmeans(spark.createDataFrame(rows, "id long, u double, v double"), ["u", "v"], 2).toPandas().set_index("id").label
    assert got.isna().sum() == 1 and set(got.dropna()) == {1, 2}
    assert all(got[i] == got[i % 2] for i in range(60))


def test_geojson_and_tables_round_trip(spark, tmp_path):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (0.0, 1.0))))
    df = spark.createDataFrame([(1, 'a "b"\nc', 2.5), (2, "", None), (3, None, -1.0)], "id long, name string, v double")
    shapes = df.withColumn("rings", F.when(F.col("id") < 3, F.array(ring)))
    files.write_geojson(shapes, f"{tmp_path}/g")
    back = files.read_geojson(spark, f"{tmp_path}/g", "id long, name string, v double")
    assert sorted(back.collect()) == sorted(shapes.collect())
    files.write_table(df, f"{tmp_path}/t")
    assert sorted(files.read_table(spark, f"{tmp_path}/t", "id long, name string, v double").collect()) == sorted(df.collect())
    (tmp_path / "r.xyz").write_text("5 5 1.5\n15, 5, -9\nno line\n25;35;4\n")
    assert {tuple(r) for r in files.read_xyz(spark, f"{tmp_path}/r.xyz", 10, -9).collect()} == {(0, 0, 1.5), (3, 2, 4.0)}


def test_hull_shapes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 30):
        p = rng.integers(0, 9, (n, 2)).astype(float)
        h = hulls.hull(p)
        assert {tuple(c) for c in h} <= {tuple(c) for c in p}
        for i in range(len(h) if len(h) > 2 else 0):  # every point left of every side
            a, b = h[i], h[(i + 1) % len(h)]
            assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= -1e-9).all()
        r = hulls.least_circle(h)
        grid = [max(np.hypot(*(p - (x, y)).T)) for x in np.arange(0, 8.01, 0.1) for y in np.arange(0, 8.01, 0.1)]
        assert r <= min(grid) + 1e-9 <= r + 0.08
        boxes = []
        for t in np.linspace(0, math.pi / 2, 2000):
            u = np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) @ p.T
            boxes.append(np.ptp(u[0]) * np.ptp(u[1]))
        length, width = hulls.least_rectangle(h)
        assert length * width <= min(boxes) + 1e-9 and min(boxes) <= length * width + 0.2
    rows = [(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 2.0, 2.0), (1, 0.0, 2.0), (1, 1.0, 1.0), (2, 5.0, 5.0), (2, None, 1.0)]
    got = {r["key"]: r for r in hulls.group_shapes(spark.createDataFrame(rows, "key long, x double, y double").repartition(3)).collect()}
    assert (got[1]["corners"], got[1]["area"], got[1]["length"]) == (4, 4.0, 2.0) and math.isclose(got[1]["reock"], 2 / math.pi)
    assert got[2]["reock"] is None and got[2]["corners"] == 1


def test_shapes_of_many_small_groups_take_a_moment(spark):
    rng = random.Random(4)
    rows = [(k, rng.random() * 50, rng.random() * 50) for k in range(3000) for _ in range(4)]
    df = spark.createDataFrame(rows, "key long, x double, y double").cache()
    df.count()
    began = time.time()
    got = hulls.group_shapes(df).collect()
    assert len(got) == 3000 and all(0 < r["reock"] <= 1 for r in got)
    assert time.time() - began < 8
