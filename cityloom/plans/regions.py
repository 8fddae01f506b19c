"""Queries of partitions, clusters, matches and transfers between layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import columns as fx
from cityloom.operators import hulls, partition, spatial
from cityloom.plans.places import _AREA, _MEET, rook
from cityloom.plans.register import query, r6, read
from cityloom.sources.layers import layer


@query(None)
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rook edges by difference in population; the least forest has no SQL."""
    u = layer(spark, sf_dir, "units")
    e = rook(spark, sf_dir).where("a < b").join(u.select(F.col("unit_id").alias("a"), F.col("population").alias("pa")), "a").join(u.select(F.col("unit_id").alias("b"), F.col("population").alias("pb")), "b")
    return partition.spanning_forest(u.select(F.col("unit_id").alias("id")), e.select("a", "b", F.abs(F.col("pa") - F.col("pb")).alias("w")))


@query(None)
def merge_small_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units under 3000 people join others in squares of 250 m; the greedy order has no SQL."""
    u = layer(spark, sf_dir, "units")
    zone = F.floor(F.col("x0") / 250) * 1000 + F.floor(F.col("y0") / 250)
    return partition.merge_small(u.select(F.col("unit_id").alias("id"), zone.alias("zone"), F.col("population").alias("size")), rook(spark, sf_dir).withColumn("len", F.lit(50.0)), 3000)


@query(None)
def kmeans_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints by area, frontage and second height; labels of k-means have no SQL."""
    f = layer(spark, sf_dir, "footprints").withColumn("front", F.col("x1") - F.col("x0"))
    return partition.kmeans(f, ["area", "front", "h2"], 4)


@query(f"""WITH p AS (SELECT a.id, a.area, b.id AS b_id, b.area AS b_area, {_AREA} AS shared FROM footprints a JOIN footprints b ON a.src = 0 AND b.src = 1 AND {_MEET})
SELECT a.id, count(p.b_id) AS n, first(p.b_id ORDER BY p.shared DESC, p.b_id) FILTER (WHERE p.b_id IS NOT NULL) AS best, round(coalesce(sum(shared), 0) / a.area, 6) AS coverage, round(max(shared / (p.area + b_area - shared)), 6) AS iou,
CASE WHEN count(p.b_id) = 0 THEN 'none' WHEN count(p.b_id) = 1 THEN 'one' ELSE 'many' END AS relation FROM footprints a LEFT JOIN p USING (id) WHERE a.src = 0 GROUP BY a.id, a.area""")
def overlap_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layer(spark, sf_dir, "footprints")
    s = F.col("shared")
    pairs = spatial.rect_pairs(f.where("src = 0"), f.where("src = 1")).withColumn("shared", fx.overlap_area("a_", "b_"))
    best = F.min_by("b_id", F.struct((-s).alias("s"), "b_id"))
    m = pairs.groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"), best.alias("best"), F.sum(s).alias("total"), F.max(s / (F.col("a_area") + F.col("b_area") - s)).alias("iou"))
    out = f.where("src = 0").select("id", "area").join(m, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    relation = F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many")
    return out.select("id", "n", "best", r6(F.coalesce("total", F.lit(0.0)) / F.col("area")).alias("coverage"), r6("iou").alias("iou"), relation.alias("relation"))


@query("SELECT a.unit_id AS a, b.unit_id AS b FROM units a JOIN units b ON a.unit_id < b.unit_id AND abs(a.x0 - b.x0) = 50 AND abs(a.y0 - b.y0) = 50")
def point_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that meet in one corner only, by an equi join on corners."""
    u = layer(spark, sf_dir, "units")
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    meet = lambda p, q: u.select(F.col("unit_id").alias("a"), p.alias("at")).join(u.select(F.col("unit_id").alias("b"), q.alias("at")), "at")
    both = meet(at("x1", "y1"), at("x0", "y0")).unionAll(meet(at("x1", "y0"), at("x0", "y1")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


@query("SELECT r, c, CAST(count(CASE WHEN v > 40 THEN 1 END) AS BIGINT) AS sources, count(CASE WHEN v > 40 THEN 1 END) >= 2 AS consensus, count(CASE WHEN v > 40 THEN 1 END) = 1 AND coalesce(bool_or(band = 'N' AND v > 40), FALSE) AS gap FROM cells GROUP BY r, c")
def source_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count_if(F.col("v") > 40)
    only = F.coalesce(F.bool_or((F.col("band") == "N") & (F.col("v") > 40)), F.lit(False))
    return layer(spark, sf_dir, "cells").groupBy("r", "c").agg(n.alias("sources"), (n >= 2).alias("consensus"), ((n == 1) & only).alias("gap"))


@query(f"""WITH old AS (SELECT unit_id, x0 + 20 AS x0, y0 + 10 AS y0, x1 + 20 AS x1, y1 + 10 AS y1, population FROM units),
k AS (SELECT b.unit_id, a.population, {_AREA} AS shared FROM old a JOIN units b ON {_MEET}) SELECT unit_id, count(*) AS n, round(sum(population * shared) / sum(shared), 6) AS mean, round(sum(shared) / 2500, 6) AS share FROM k GROUP BY unit_id""")
def segment_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of former units by shared area, as weighted means."""
    u = layer(spark, sf_dir, "units")
    old = u.withColumns({c: F.col(c) + d for c, d in (("x0", 20), ("x1", 20), ("y0", 10), ("y1", 10))})
    pairs = spatial.rect_pairs(old, u).withColumn("shared", fx.overlap_area("a_", "b_"))
    mean = F.try_divide(F.sum(F.col("a_population") * F.col("shared")), F.sum("shared"))
    return pairs.groupBy(F.col("b_unit_id").alias("unit_id")).agg(F.count("*").alias("n"), r6(mean).alias("mean"), r6(F.sum("shared") / 2500).alias("share"))


@query("""WITH o AS (SELECT n_nationkey AS k, lower(n_name) AS name FROM nation WHERE n_nationkey % 2 = 0), p AS (SELECT left(name, 2) AS s, min(k) AS k FROM o GROUP BY 1)
SELECT n.n_nationkey, coalesce(o.k, p.k) AS to_key, CASE WHEN o.k IS NOT NULL THEN 'name' WHEN p.k IS NOT NULL THEN 'fallback' END AS how FROM nation n LEFT JOIN o ON o.name = lower(n.n_name) LEFT JOIN p ON p.s = left(lower(n.n_name), 2)""")
def name_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name's own key in the other list, else the first with the same two letters."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", fx.normalize_text(F.col("n_name")).alias("name"))
    o = n.where("n_nationkey % 2 = 0").select("name", F.col("n_nationkey").alias("k"))
    p = o.groupBy(F.substring("name", 1, 2).alias("s")).agg(F.min("k").alias("pk"))
    out = n.join(o, "name", "left").join(p, F.substring(n["name"], 1, 2) == p["s"], "left")
    return out.select("n_nationkey", F.coalesce("k", "pk").alias("to_key"), F.when(F.col("k").isNotNull(), "name").when(F.col("pk").isNotNull(), "fallback").alias("how"))


@query("""WITH d AS (SELECT unit_id AS id, sqrt(pow(x0 + 25 - x, 2) + pow(y0 + 25 - y, 2)) AS dist, p.id AS t FROM units, points p), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, t) AS rank FROM d)
SELECT id, round(max(CASE WHEN rank = 1 THEN dist END), 6) AS nn1, round(max(CASE WHEN rank = 5 THEN dist END), 6) AS nn5, round(max(CASE WHEN rank = 10 THEN dist END), 6) AS nn10, round(avg(dist), 6) AS mean10 FROM k WHERE rank <= 10 GROUP BY id""")
def knn_distance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = layer(spark, sf_dir, "units").select(F.col("unit_id").alias("id"), (F.col("x0") + 25).alias("x"), (F.col("y0") + 25).alias("y"))
    near = spatial.nearest(centres, layer(spark, sf_dir, "points"), 10, 32.0)
    at = lambda k: r6(F.max(F.when(F.col("rank") == k, F.col("dist")))).alias(f"nn{k}")
    return near.groupBy("id").agg(at(1), at(5), at(10), r6(F.avg("dist")).alias("mean10"))


@query(None)
def unit_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of the points of each unit; convex hulls have no SQL."""
    at = spatial.points_in(layer(spark, sf_dir, "points"), layer(spark, sf_dir, "units"))
    return hulls.group_shapes(at.select(F.col("b_unit_id").alias("key"), "x", "y")).withColumnRenamed("key", "unit_id")
