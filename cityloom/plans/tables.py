"""Queries of joins, grouped summaries, windows and set operations over the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityloom.functions import columns as fx
from cityloom.functions import rules as fr
from cityloom.operators import joins, spatial
from cityloom.plans.catalog import PRODUCTS, wide
from cityloom.plans.places import _AREA, _MEET, _ROOK, labels, rook
from cityloom.plans.register import query, r6, read
from cityloom.plans.rules import flagged, made
from cityloom.sources.layers import layer

# Joins ---------------------------------------------------------------------------------------


@query("SELECT w.id, w.highway, b.class FROM ways w LEFT JOIN blocks b ON b.id = w.unit_id")
def join_left_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layer(spark, sf_dir, "blocks").select(F.col("id").alias("unit_id"), "class")
    return joins.left_validated(layer(spark, sf_dir, "ways").select("id", "unit_id", "highway"), b, ["unit_id"]).select("id", "highway", "class")


@query("SELECT w.id, f.id AS f_id FROM ways w JOIN footprints f ON f.id = w.unit_id AND w.status = 'F'")
def join_inner_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = layer(spark, sf_dir, "ways").where("status = 'F'").select("id", F.col("unit_id").alias("f_id"))
    return w.join(layer(spark, sf_dir, "footprints").select(F.col("id").alias("f_id")), "f_id").select("id", "f_id")


@query("SELECT u.unit_id, coalesce(n, 0) AS n FROM units u LEFT JOIN (SELECT unit_id, count(*) AS n FROM ways WHERE highway = 'primary' GROUP BY unit_id) USING (unit_id)")
def join_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = layer(spark, sf_dir, "ways").where("highway = 'primary'").groupBy("unit_id").agg(F.count("*").alias("n"))
    return joins.lookup(layer(spark, sf_dir, "units").select("unit_id"), counts, "unit_id", "n", F.lit(0))


_BOXES = "SELECT n_nationkey AS id, CAST(n_nationkey * 37 % 100 AS DOUBLE) AS x0, CAST(n_nationkey * 53 % 100 AS DOUBLE) AS y0, CAST(n_nationkey * 37 % 100 + 20 AS DOUBLE) AS x1, CAST(n_nationkey * 53 % 100 + 20 AS DOUBLE) AS y1 FROM nation"
_OTHERS = "SELECT id + 100 AS id, x0 + id % 9 AS x0, y0 + id % 5 AS y0, x1 + id % 9 AS x1, y1 + id % 5 AS y1 FROM boxes"


@query(f"""WITH boxes AS ({_BOXES}), others AS ({_OTHERS}), s AS (SELECT a.id, b.id AS match, {_AREA} / 400 AS share, sqrt(pow(a.x0 - b.x0, 2) + pow(a.y0 - b.y0, 2)) AS dist FROM boxes a JOIN others b ON {_MEET})
SELECT id, match, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, dist, match) AS k FROM s) WHERE k = 1 AND share >= 0.5""")
def bbox_group_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each box the one that it shares most with (then the nearest), half of it at least."""
    boxes = spark.sql(_BOXES.replace("FROM nation", "FROM {n}"), n=read(spark, sf_dir, "nation"))
    others = spark.sql(_OTHERS.replace("FROM boxes", "FROM {b}"), b=boxes)
    pairs = spatial.rect_pairs(boxes, others, 20.0)
    dist = F.sqrt(F.pow(F.col("a_x0") - F.col("b_x0"), 2) + F.pow(F.col("a_y0") - F.col("b_y0"), 2))
    s = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("match"), (fx.overlap_area("a_", "b_") / 400).alias("share"), dist.alias("dist"))
    best = s.groupBy("id").agg(F.min(F.struct((-F.col("share")).alias("s"), "dist", "match")).alias("m"))
    return best.select("id", "m.match", r6(-F.col("m.s")).alias("share")).where("-m.s >= 0.5")


_INSIDE = "{p}.x >= u.x0 AND {p}.x < u.x1 AND {p}.y >= u.y0 AND {p}.y < u.y1"
_CENTRES = "(SELECT id, area, src, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM footprints)"


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = lambda c: ((F.col(c + "0") + F.col(c + "1")) / 2).alias(c)
    return layer(spark, sf_dir, "footprints").select("id", "area", "src", mid("x"), mid("y"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit of each building's centre, and its columns."""
    hit = spatial.points_in(centres(spark, sf_dir), layer(spark, sf_dir, "units"))
    return hit.groupBy("id").agg(F.min(F.struct("b_unit_id", "b_zone", "b_population", "area", "src")).alias("h")).select("id", F.col("h.b_unit_id").alias("unit_id"), F.col("h.b_zone").alias("zone"), F.col("h.b_population").alias("population"), F.col("h.area").alias("area"), F.col("h.src").alias("src"))


_ASSIGNED = f"(SELECT c.id, c.area, c.src, u.unit_id, u.zone, u.population FROM {_CENTRES} c JOIN units u ON {_INSIDE.format(p='c')})"


@query(f"SELECT f.id, a.zone FROM footprints f LEFT JOIN {_ASSIGNED} a USING (id)")
def assign_zone_to_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zone that a block's inner point lies in; blocks outside all zones have none."""
    return layer(spark, sf_dir, "footprints").select("id").join(assigned(spark, sf_dir).select("id", "zone"), "id", "left")


@query(f"SELECT f.id, coalesce(a.unit_id, f.src) AS admin FROM footprints f LEFT JOIN {_ASSIGNED} a USING (id)")
def assign_admin_to_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit over the inner point overwrites the former value."""
    f = layer(spark, sf_dir, "footprints").select("id", F.col("src").alias("was"))
    return f.join(assigned(spark, sf_dir).select("id", "unit_id"), "id", "left").select("id", F.coalesce("unit_id", "was").alias("admin"))


@query(f"SELECT f.id, a.zone, a.population FROM footprints f LEFT JOIN {_ASSIGNED} a USING (id)")
def assign_zone5_to_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "footprints").select("id").join(assigned(spark, sf_dir).select("id", "zone", "population"), "id", "left")


@query(f"SELECT c.id FROM {_CENTRES} c WHERE EXISTS (SELECT 1 FROM units u WHERE u.zone IN (1, 2) AND {_INSIDE.format(p='c')})")
def select_center_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_in(centres(spark, sf_dir), layer(spark, sf_dir, "units").where("zone IN (1, 2)")).select("id").distinct()


@query(f"SELECT zone, count(*) AS n, sum(area) AS area FROM {_ASSIGNED} GROUP BY zone")
def cluster_group_by_tess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).groupBy("zone").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query(f"SELECT b.unit_id FROM units b WHERE EXISTS (SELECT 1 FROM footprints a WHERE a.src = 2 AND {_MEET})")
def sjoin_semi_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.rect_pairs(layer(spark, sf_dir, "footprints").where("src = 2"), layer(spark, sf_dir, "units")).select(F.col("b_unit_id").alias("unit_id")).distinct()


_NEAR = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))"


@query(f"""SELECT id, match, round(dist, 6) AS dist FROM (SELECT a.id, b.id AS match, {_NEAR} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {_NEAR}, b.id) AS k FROM {_CENTRES} a JOIN {_CENTRES} b ON a.src = 0 AND b.src = 1
WHERE {_NEAR} <= least(4, 0.35 * sqrt(least(a.area, b.area))) * 5 AND a.area / b.area BETWEEN 0.35 AND 2.85) WHERE k = 1""")
def sjoin_nearest_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest preferred building of like size within a reach that its size sets."""
    c = centres(spark, sf_dir)
    pairs = spatial.points_within(c, 20.0).where("a_src = 0 AND b_src = 1")
    ok = (F.col("dist") <= F.least(F.lit(4.0), 0.35 * F.sqrt(F.least("a_area", "b_area"))) * 5) & (F.col("a_area") / F.col("b_area")).between(0.35, 2.85)
    best = pairs.where(ok).groupBy("a_id").agg(F.min(F.struct("dist", "b_id")).alias("m"))
    return best.select(F.col("a_id").alias("id"), F.col("m.b_id").alias("match"), r6(F.col("m.dist")).alias("dist"))


_GAP = "sqrt(pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2))"


@query(f"SELECT id, other, round(dist, 6) AS dist, CAST(k AS INT) AS k FROM (SELECT a.unit_id AS id, b.unit_id AS other, {_GAP} AS dist, row_number() OVER (PARTITION BY a.unit_id ORDER BY {_GAP}, b.unit_id) AS k FROM units a JOIN units b ON a.zone = b.zone AND a.unit_id <> b.unit_id AND {_GAP} <= 400) WHERE k <= 8")
def nearest_k_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 8 nearest regions of the same zone by the distance of their edges, to 400 m."""
    u = layer(spark, sf_dir, "units").withColumns({"id": F.col("unit_id"), "x": F.col("x0"), "y": F.col("y0")})
    pairs = spatial.points_within(u, 640.0).where("a_zone = b_zone")
    gap = lambda c: F.greatest(F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.lit(0.0))
    pairs = pairs.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), F.sqrt(F.pow(gap("x"), 2) + F.pow(gap("y"), 2)).alias("dist")).where("dist <= 400")
    k = F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))
    return pairs.withColumn("k", k).where("k <= 8").select("id", "other", r6("dist").alias("dist"), "k")


@query(f"SELECT id, unit_id, round(share, 6) AS share FROM (SELECT a.id, b.unit_id, {_AREA} / a.area AS share, row_number() OVER (PARTITION BY a.id ORDER BY {_AREA} DESC, b.unit_id) AS k FROM footprints a JOIN units b ON {_MEET}) WHERE k = 1 AND share >= 0.5")
def pip_share_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit that holds most of a building, half of it at least."""
    pairs = spatial.rect_pairs(layer(spark, sf_dir, "footprints"), layer(spark, sf_dir, "units"))
    s = pairs.select(F.col("a_id").alias("id"), "b_unit_id", (fx.overlap_area("a_", "b_") / F.col("a_area")).alias("share"))
    best = s.groupBy("id").agg(F.min(F.struct((-F.col("share")).alias("s"), "b_unit_id")).alias("m"))
    return best.where("-m.s >= 0.5").select("id", F.col("m.b_unit_id").alias("unit_id"), r6(-F.col("m.s")).alias("share"))


@query(f"""SELECT unit_id, src, CASE WHEN src = 0 THEN max_by(id, a * 1000000 - id) END AS chosen, CASE WHEN src = 0 THEN max(a) ELSE sum(a) END AS area FROM (SELECT b.unit_id, a.src, a.id, {_AREA} AS a FROM footprints a JOIN units b ON {_MEET}) GROUP BY unit_id, src""")
def max_overlap_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first source the feature that overlaps most, of the others all."""
    pairs = spatial.rect_pairs(layer(spark, sf_dir, "footprints"), layer(spark, sf_dir, "units")).withColumn("a", fx.overlap_area("a_", "b_"))
    per = pairs.groupBy(F.col("b_unit_id").alias("unit_id"), F.col("a_src").alias("src")).agg(F.min(F.struct((-F.col("a")).alias("s"), "a_id")).alias("m"), F.sum("a").alias("total"))
    one = F.col("src") == 0
    return per.select("unit_id", "src", F.when(one, F.col("m.a_id")).alias("chosen"), F.when(one, -F.col("m.s")).otherwise(F.col("total")).alias("area"))


@query("SELECT b.id, m.tile FROM blocks b JOIN (SELECT p_partkey AS tile, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_partkey % 25 END AS country FROM part WHERE p_size = 1) m ON m.country IS NULL OR m.country = b.zone WHERE b.step = 3")
def country_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of a block's country, and those of all countries: an equi join and a join on a constant."""
    b = layer(spark, sf_dir, "blocks").where("step = 3").select("id", F.col("zone").cast("long").alias("country"))
    m = read(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("tile"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey") % 25).alias("country"))
    every = F.lit(-1).cast("long")
    keyed = b.withColumn("k", F.explode(F.array("country", every)))
    return keyed.join(m.select("tile", F.coalesce("country", every).alias("k")), "k").select("id", "tile")


# Aggregations --------------------------------------------------------------------------------

_SIX = "count(area) AS n, round(avg(area), 6) AS mean, round(median(area), 6) AS med, round(min(area), 6) AS low, round(max(area), 6) AS high, round(stddev_samp(area), 6) AS sd"


def six(c: str) -> list:
    return [F.count(c).alias("n"), r6(F.avg(c)).alias("mean"), r6(F.median(c)).alias("med"), r6(F.min(c)).alias("low"), r6(F.max(c)).alias("high"), r6(F.stddev_samp(c)).alias("sd")]


@query(f"SELECT zone, class, {_SIX} FROM blocks GROUP BY zone, class")
def agg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "blocks").groupBy("zone", "class").agg(*six("area"))


_PIECES = f"(SELECT a.id, b.unit_id, a.area, {_AREA} AS piece FROM footprints a JOIN units b ON {_MEET})"


@query(f"""WITH pt AS (SELECT unit_id, count(*) AS n, max(area) AS high FROM {_ASSIGNED} GROUP BY unit_id),
inn AS (SELECT unit_id, min(area) AS low, median(area) AS med, avg(area) AS mean, CASE WHEN count(*) > 1 THEN stddev_samp(area) ELSE 0 END AS sd, sum(area) AS total FROM {_PIECES} WHERE piece = area GROUP BY unit_id),
cl AS (SELECT unit_id, sum(piece) AS total FROM {_PIECES} WHERE piece < area GROUP BY unit_id)
SELECT u.unit_id, coalesce(n, 0) AS n, high, low, round(med, 6) AS med, round(mean, 6) AS mean, round(sd, 6) AS sd, coalesce(inn.total, 0) + coalesce(cl.total, 0) AS total FROM units u LEFT JOIN pt USING (unit_id) LEFT JOIN inn USING (unit_id) LEFT JOIN cl USING (unit_id)""")
def agg_unit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and largest by centres, statistics of contained buildings, areas with the clipped ones."""
    pieces = spatial.rect_pairs(layer(spark, sf_dir, "footprints"), layer(spark, sf_dir, "units")).select(F.col("b_unit_id").alias("unit_id"), F.col("a_area").alias("area"), fx.overlap_area("a_", "b_").alias("piece"))
    whole = F.when(F.col("piece") == F.col("area"), F.col("area"))
    inside = pieces.groupBy("unit_id").agg(F.min(whole).alias("low"), r6(F.median(whole)).alias("med"), r6(F.avg(whole)).alias("mean"), r6(F.when(F.count(whole) > 1, F.stddev_samp(whole)).when(F.count(whole) == 1, 0.0)).alias("sd"), F.sum("piece").alias("total"))
    by_point = assigned(spark, sf_dir).groupBy("unit_id").agg(F.count("*").alias("n"), F.max("area").alias("high"))
    out = layer(spark, sf_dir, "units").select("unit_id").join(by_point, "unit_id", "left").join(inside, "unit_id", "left")
    return out.select("unit_id", F.coalesce("n", F.lit(0)).alias("n"), "high", "low", "med", "mean", "sd", F.coalesce("total", F.lit(0.0)).alias("total"))


@query(f"""SELECT unit_id, count(*) AS n, count_if(src = 0) AS osm, count_if(src <> 0) AS fill, round(median(area), 6) AS med, sum(CASE WHEN src = 0 THEN area ELSE 0 END) AS a0, sum(CASE WHEN src = 1 THEN area ELSE 0 END) AS a1,
round(sum(CASE WHEN src = 1 AND id % 2 = 0 THEN area / 2 ELSE 0 END) / nullif(sum(CASE WHEN src < 2 THEN area ELSE 0 END) - sum(CASE WHEN src = 1 AND id % 2 = 0 THEN area / 2 ELSE 0 END), 0), 6) AS iou FROM {_ASSIGNED} GROUP BY unit_id""")
def agg_segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source, medians, and shared over united area, where half of each second match is shared."""
    a = F.col("area")
    first, second = F.sum(F.when(F.col("src") == 0, a).otherwise(0.0)), F.sum(F.when(F.col("src") == 1, a).otherwise(0.0))
    shared = F.sum(F.when((F.col("src") == 1) & (F.col("id") % 2 == 0), a / 2).otherwise(0.0))
    per = assigned(spark, sf_dir).groupBy("unit_id").agg(F.count("*").alias("n"), F.count_if(F.col("src") == 0).alias("osm"), F.count_if(F.col("src") != 0).alias("fill"), r6(F.median("area")).alias("med"), first.alias("a0"), second.alias("a1"), shared.alias("s"))
    return per.select("unit_id", "n", "osm", "fill", "med", "a0", "a1", r6(F.try_divide(F.col("s"), F.col("a0") + F.col("a1") - F.col("s"))).alias("iou"))


@query("SELECT unit_id, min(first) AS first, max(distinct_n) AS kinds FROM (SELECT unit_id, min(id) AS first, count(DISTINCT highway) AS distinct_n FROM ways GROUP BY unit_id) GROUP BY unit_id")
def agg_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "ways").groupBy("unit_id").agg(F.min("id").alias("first"), F.countDistinct("highway").alias("kinds"))


@query("SELECT unit_id FROM ways GROUP BY unit_id HAVING count(DISTINCT status) > 1")
def agg_constancy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys for which a value that should be constant is not."""
    return layer(spark, sf_dir, "ways").groupBy("unit_id").agg(F.min("status").alias("a"), F.max("status").alias("b")).where("a <> b").select("unit_id")


_P9 = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


@query("SELECT zone, " + ", ".join(f"round(quantile_cont(area, {p}), 6) AS p{int(p * 100)}" for p in _P9) + " FROM blocks GROUP BY zone")
def agg_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = layer(spark, sf_dir, "blocks").groupBy("zone").agg(F.percentile("area", F.array(*map(F.lit, _P9))).alias("q"))
    return q.select("zone", *(r6(F.col("q")[i]).alias(f"p{int(p * 100)}") for i, p in enumerate(_P9)))


@query("SELECT zone, step, CASE WHEN count(balance) > 1 AND avg(balance) > 0 THEN round(stddev_samp(balance) / avg(balance), 6) END AS cv FROM blocks GROUP BY zone, step")
def agg_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "balance"
    return layer(spark, sf_dir, "blocks").groupBy("zone", "step").agg(r6(F.when((F.count(c) > 1) & (F.avg(c) > 0), F.stddev_samp(c) / F.avg(c))).alias("cv"))


_CODES = "(SELECT DISTINCT band, r, c, CAST(floor(r / 16) AS BIGINT) AS city FROM cells WHERE v > 20)"


@query(f"""WITH k AS {_CODES}, n AS (SELECT city, band, count(*) AS n FROM k GROUP BY city, band), s AS (SELECT a.city, a.band AS pa, b.band AS pb, count(*) AS shared FROM k a JOIN k b ON a.r = b.r AND a.c = b.c AND a.band < b.band GROUP BY ALL),
i AS (SELECT x.city, x.band AS pa, y.band AS pb, coalesce(shared, 0) / (x.n + y.n - coalesce(shared, 0)) AS iou FROM n x JOIN n y ON x.city = y.city AND x.band < y.band LEFT JOIN s ON s.city = x.city AND s.pa = x.band AND s.pb = y.band)
SELECT pa, pb, count(*) AS n, round(median(iou), 6) AS med, round(quantile_cont(iou, 0.75) - quantile_cont(iou, 0.25), 6) AS iqr, round(avg(iou), 6) AS mean FROM i GROUP BY pa, pb""")
def agg_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared over united cells of each pair of products in each city, and their spread.  Cells
    carry the set of their products, so pairs are counted without a self join."""
    at = layer(spark, sf_dir, "cells").where("v > 20").groupBy("r", "c").agg(F.array_sort(F.collect_set("band")).alias("bands")).withColumn("city", F.floor(F.col("r") / 16))
    pairs = F.flatten(F.transform("bands", lambda a: F.transform(F.col("bands"), lambda b: F.struct(a.alias("pa"), b.alias("pb")))))
    n = at.select("city", F.explode(pairs).alias("p")).select("city", "p.*").where("pa <= pb").groupBy("city", "pa", "pb").agg(F.count("*").alias("n"))
    own = n.where("pa = pb").select("city", F.col("pa").alias("band"), F.col("n").alias("own"))
    both = own.withColumnsRenamed({"band": "pa", "own": "na"}).join(own.withColumnsRenamed({"band": "pb", "own": "nb"}), "city").where("pa < pb").join(n, ["city", "pa", "pb"], "left")
    shared = F.coalesce("n", F.lit(0))
    iou = both.select("pa", "pb", (shared / (F.col("na") + F.col("nb") - shared)).alias("iou"))
    return iou.groupBy("pa", "pb").agg(F.count("*").alias("n"), r6(F.median("iou")).alias("med"), r6(F.percentile("iou", F.lit(0.75)) - F.percentile("iou", F.lit(0.25))).alias("iqr"), r6(F.avg("iou")).alias("mean"))


@query("SELECT zone, round(sum(people) / nullif(sum(step), 0), 6) AS ratio, round(sum(CASE WHEN label = 0 THEN people ELSE 0 END) / nullif(sum(CASE WHEN label = 0 THEN step ELSE 0 END), 0), 6) AS ratio0 FROM blocks GROUP BY zone")
def agg_table_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.col("label") == 0
    some = lambda c: F.sum(F.when(zero, F.col(c)).otherwise(0))
    return layer(spark, sf_dir, "blocks").groupBy("zone").agg(r6(F.try_divide(F.sum("people"), F.sum("step"))).alias("ratio"), r6(F.try_divide(some("people"), some("step"))).alias("ratio0"))


@query("SELECT product, CAST(unit_id % 5 AS BIGINT) AS city, count(v) AS valid, count(*) - count(v) AS missing, round(100.0 * count(v) / count(*), 6) AS pct FROM products GROUP BY product, unit_id % 5")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "products").groupBy("product", (F.col("unit_id") % 5).alias("city")).agg(F.count("v").alias("valid"), F.count_if(F.col("v").isNull()).alias("missing"), r6(100 * F.count("v") / F.count("*")).alias("pct"))


_HEX = {"hex": "CASE WHEN id % 4 = 0 THEN concat('h', CAST(id AS STRING)) END"}


@query("SELECT zone, count(*) AS n, count_if(id % 4 = 0) AS void, round(median(area) / 10000, 6) AS med_ha, round(100 * sum(area) / (SELECT sum(area) FROM blocks), 6) AS pct FROM blocks GROUP BY zone")
def agg_units_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, "blocks", **_HEX)
    total = F.broadcast(rows.agg(F.sum("area").alias("all")))  # one row
    per = rows.groupBy("zone").agg(F.count("*").alias("n"), F.count("hex").alias("void"), r6(F.median("area") / 10000).alias("med_ha"), F.sum("area").alias("a"))
    return per.crossJoin(total).select("zone", "n", "void", "med_ha", r6(100 * F.col("a") / F.col("all")).alias("pct"))


@query("""SELECT zone, CAST(sum(people) AS BIGINT) AS people, CAST(sum(step) AS BIGINT) AS cells, round(CAST(sum(step) AS DOUBLE) * 100 / 1000000, 6) AS km2, round(100 * sum(CASE WHEN id % 4 = 0 THEN step ELSE 0 END) / nullif(CAST(sum(step) AS DOUBLE), 0), 6) AS pct_void, round(sum(step * CAST(1.5 AS DOUBLE)), 6) AS estimated FROM blocks GROUP BY zone""")
def agg_city_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, void = F.col("step"), F.col("id") % 4 == 0
    return layer(spark, sf_dir, "blocks").groupBy("zone").agg(F.sum("people").alias("people"), F.sum("step").alias("cells"), r6(F.sum("step") * 100 / F.lit(1e6)).alias("km2"), r6(F.try_divide(100 * F.sum(F.when(void, step).otherwise(0)).cast("double"), F.sum("step").cast("double"))).alias("pct_void"), r6(F.sum(step * F.lit(1.5))).alias("estimated"))


@query("""SELECT zone, count(*) AS n, count_if(a) AS rule_a, count_if(b) AS rule_b, count_if(a OR b) AS either, count_if(m) AS missing, count_if((a OR b) AND m) AS both, round(100 * sum(CASE WHEN a OR b OR m THEN people ELSE 0 END) / nullif(sum(people), 0), 6) AS pct_people
FROM (SELECT zone, people, coalesce(label, 0) >= 2 AS a, coalesce(prob < 0.1, FALSE) AS b, coalesce(step, 0) >= 18 AS m FROM blocks) GROUP BY zone""")
def agg_flag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layer(spark, sf_dir, "blocks").select("zone", "people", (F.coalesce("label", F.lit(0)) >= 2).alias("a"), fr.no(F.col("prob") < 0.1).alias("b"), (F.coalesce("step", F.lit(0)) >= 18).alias("m"))
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    share = F.try_divide(F.sum(F.when(F.expr("a OR b OR m"), F.col("people")).otherwise(0)), F.sum("people"))
    return rows.groupBy("zone").agg(F.count("*").alias("n"), n("a", "rule_a"), n("b", "rule_b"), n("a OR b", "either"), n("m", "missing"), n("(a OR b) AND m", "both"), r6(100 * share).alias("pct_people"))


_SCEN = "SELECT scenario, count_if(n >= 2) AS comparable, round(median(CASE WHEN n >= 2 THEN spread END), 6) AS med, round(quantile_cont(CASE WHEN n >= 2 THEN spread END, 0.9), 6) AS p90, round(avg(n), 6) AS mean_n FROM s GROUP BY scenario"
_SPREAD = "SELECT '{name}' AS scenario, len(v) AS n, list_max(v) - list_min(v) AS spread FROM (SELECT list_filter([{cols}], lambda x: x IS NOT NULL) AS v FROM w)"


@query("WITH w AS (SELECT unit_id, " + ", ".join(f"max(CASE WHEN product = '{p}' THEN v END) AS {p}" for p in PRODUCTS) + " FROM products GROUP BY unit_id), s AS (" + _SPREAD.format(name="three", cols="AF, NF, NO") + " UNION ALL " + _SPREAD.format(name="all", cols="AF, NF, NO, RF") + ") " + _SCEN)
def agg_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable cells and the spread of the products, without and with the last one."""
    w = wide(spark, sf_dir)
    one = lambda name, cols: F.struct(F.lit(name).alias("scenario"), F.filter(F.array(*cols), lambda x: x.isNotNull()).alias("v"))
    s = w.select(F.inline(F.array(one("three", PRODUCTS[:3]), one("all", PRODUCTS))))
    s = s.select("scenario", F.size("v").alias("n"), F.when(F.size("v") >= 2, F.array_max("v") - F.array_min("v")).alias("spread"))
    return s.groupBy("scenario").agg(F.count("spread").alias("comparable"), r6(F.median("spread")).alias("med"), r6(F.percentile("spread", F.lit(0.9))).alias("p90"), r6(F.avg("n")).alias("mean_n"))


@query("""WITH k AS (SELECT r, c, count_if(v > 20) AS n FROM cells GROUP BY r, c), t AS (SELECT count_if(n >= 2) AS consensus FROM k)
SELECT band, count_if(v > 20) AS positive, round(100.0 * count_if(v > 20 AND n >= 2) / greatest(1, max(consensus)), 6) AS recall, round(sum(least(v / 100, 1) * 256) / 1000000, 6) AS km2 FROM cells JOIN k USING (r, c), t GROUP BY band""")
def agg_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive cells of each source, its share of the consensus of two or more, and built area."""
    cells = layer(spark, sf_dir, "cells")
    on = F.col("v") > 20
    k = cells.groupBy("r", "c").agg(F.count_if(on).alias("n"))
    total = F.broadcast(k.agg(F.count_if(F.col("n") >= 2).alias("consensus")))  # one row
    per = cells.join(k, ["r", "c"]).groupBy("band").agg(F.count_if(on).alias("positive"), F.count_if(on & (F.col("n") >= 2)).alias("hit"), r6(F.sum(F.least(F.col("v") / 100, F.lit(1.0)) * 256) / 1000000).alias("km2"))
    return per.crossJoin(total).select("band", "positive", r6(100 * F.col("hit") / F.greatest(F.lit(1), F.col("consensus"))).alias("recall"), "km2")


@query("""WITH e AS (SELECT u.unit_id, CAST(sum(population) AS DOUBLE) AS t FROM units u GROUP BY u.unit_id), s AS (SELECT zone, sum(population) AS a FROM units GROUP BY zone), k AS (SELECT zone, sum(t) AS b FROM units JOIN e USING (unit_id) GROUP BY zone)
SELECT zone, a, b, abs(a - b) <= 1e-6 AS conserved FROM s JOIN k USING (zone)""")
def agg_pop_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population by zone before and after a regrouping, and whether they agree."""
    u = layer(spark, sf_dir, "units")
    after = u.groupBy("unit_id", "zone").agg(F.sum("population").alias("t")).groupBy("zone").agg(F.sum("t").alias("b"))
    return u.groupBy("zone").agg(F.sum("population").alias("a")).join(after, "zone").select("zone", "a", "b", (F.abs(F.col("a") - F.col("b")) <= 1e-6).alias("conserved"))


@query(f"""WITH p AS {_PIECES}, t AS (SELECT unit_id, sum(piece) AS built FROM p GROUP BY unit_id), o AS (SELECT unit_id, population * piece / built AS part, id FROM p JOIN t USING (unit_id) JOIN units USING (unit_id))
SELECT id, round(sum(part), 6) AS population FROM o GROUP BY id UNION ALL SELECT CAST(-1 AS BIGINT), round(sum(population), 6) FROM units ANTI JOIN t USING (unit_id)""")
def agg_apportion_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit's people over its buildings by area; those of units without buildings are
    kept under -1, so that the total stays."""
    u = layer(spark, sf_dir, "units")
    p = spatial.rect_pairs(layer(spark, sf_dir, "footprints"), u).select(F.col("a_id").alias("id"), F.col("b_unit_id").alias("unit_id"), F.col("b_population").alias("population"), fx.overlap_area("a_", "b_").alias("piece"))
    built = p.groupBy("unit_id").agg(F.sum("piece").alias("built"))
    inside = p.join(built, "unit_id").groupBy("id").agg(r6(F.sum(F.col("population") * F.col("piece") / F.col("built"))).alias("population"))
    rest = u.join(built, "unit_id", "left_anti").agg(F.lit(-1).cast("long").alias("id"), r6(F.sum("population")).alias("population"))
    return inside.unionByName(rest)


@query("SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM blocks), 6) AS pct, round(median(area), 6) AS med_area, round(median(people), 6) AS med_people FROM blocks GROUP BY label")
def agg_cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layer(spark, sf_dir, "blocks")
    per = b.groupBy("label").agg(F.count("*").alias("n"), r6(F.median("area")).alias("med_area"), r6(F.median("people")).alias("med_people"))
    return per.crossJoin(F.broadcast(b.agg(F.count("*").alias("all")))).select("label", "n", r6(100 * F.col("n") / F.col("all")).alias("pct"), "med_area", "med_people")


_M = "sum(a) AS a, sum(a * x) AS sx, sum(a * y) AS sy, sum(a * (x * x + y * y)) AS sq"


@query(f"""WITH u AS (SELECT zone, CAST(2500 AS DOUBLE) AS a, x0 + 25 AS x, y0 + 25 AS y FROM units), s AS (SELECT zone, {_M} FROM u GROUP BY zone) SELECT zone, a AS area, round(2 * pi() * (sq - (sx * sx + sy * sy) / a + count * 2500 * 2500 / 6) / (a * a), 6) AS j FROM s JOIN (SELECT zone, count(*) AS count FROM u GROUP BY zone) USING (zone)""")
def agg_moment_j(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2 pi I / A^2 of each zone from sums over its units: 1 for a disc, more for what is spread out."""
    x, y, a = F.col("x0") + 25, F.col("y0") + 25, F.lit(2500.0)
    s = layer(spark, sf_dir, "units").groupBy("zone").agg(F.sum(a).alias("a"), F.sum(a * x).alias("sx"), F.sum(a * y).alias("sy"), F.sum(a * (x * x + y * y)).alias("sq"), F.sum(a * a / 6).alias("own"))
    inertia = F.col("sq") - (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / F.col("a") + F.col("own")
    return s.select("zone", F.col("a").alias("area"), r6(2 * F.pi() * inertia / (F.col("a") * F.col("a"))).alias("j"))


_BANDS = ((0.05, 0.25), (0.10, 1), (0.20, 3), (0.35, 6), (0.50, 10))


@query("SELECT CAST(floor(r / 8) AS BIGINT) AS blob, count(*) AS n, sum(w) AS mass, round(sum(w) / count(*), 6) AS score, round(avg(CAST(f >= 0.2 AS INT)), 6) AS share020 FROM (SELECT r, least(v / 100, 1) AS f, " + "CAST(CASE " + " ".join(f"WHEN least(v / 100, 1) >= {b} THEN {w}" for b, w in reversed(_BANDS)) + " ELSE 0 END AS DOUBLE) AS w FROM cells WHERE band = 'A') GROUP BY 1")
def agg_blob_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass and score of each blob by weights of density bands."""
    f = F.least(F.col("v") / 100, F.lit(1.0))
    w = F.when(f >= _BANDS[-1][0], float(_BANDS[-1][1]))
    for b, x in reversed(_BANDS[:-1]):
        w = w.when(f >= b, float(x))
    w = w.otherwise(0.0)
    return layer(spark, sf_dir, "cells").where("band = 'A'").groupBy(F.floor(F.col("r") / 8).alias("blob")).agg(F.count("*").alias("n"), F.sum(w).alias("mass"), r6(F.sum(w) / F.count("*")).alias("score"), r6(F.avg((f >= 0.2).cast("int"))).alias("share020"))


@query("SELECT unit_id, count_if(step BETWEEN 1 AND 15) AS to15, count_if(step BETWEEN 1 AND 20) AS to20, count_if(step BETWEEN 19 AND 20) AS last1, count_if(step BETWEEN 15 AND 20) AS last3 FROM (SELECT zone AS unit_id, step FROM blocks) GROUP BY unit_id")
def agg_tabulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda a, b: F.count_if(F.col("step").between(a, b))
    return layer(spark, sf_dir, "blocks").groupBy(F.col("zone").alias("unit_id")).agg(n(1, 15).alias("to15"), n(1, 20).alias("to20"), n(19, 20).alias("last1"), n(15, 20).alias("last3"))


@query("""WITH s AS (SELECT zone, label, sum(area) AS len FROM blocks GROUP BY zone, label), m AS (SELECT zone, max(len) AS top, sum(len) AS total FROM s GROUP BY zone)
SELECT zone, CASE WHEN count_if(abs(len - top) < 1e-9) > 1 THEN 1 ELSE min(CASE WHEN abs(len - top) < 1e-9 THEN label END) END AS vote, round(max(top), 6) AS top, count_if(abs(len - top) < 1e-9) > 1 AS tie FROM s JOIN m USING (zone) GROUP BY zone""")
def agg_weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label with the greatest length; of several with the same the default, 1."""
    s = layer(spark, sf_dir, "blocks").groupBy("zone", "label").agg(F.sum("area").alias("len"))
    per = s.groupBy("zone").agg(F.max("len").alias("top"), F.collect_list(F.struct("label", "len")).alias("all"))
    won = F.filter("all", lambda x: F.abs(x["len"] - F.col("top")) < 1e-9)
    return per.select("zone", F.when(F.size(won) > 1, 1).otherwise(F.get(won, F.lit(0))["label"]).alias("vote"), r6("top").alias("top"), (F.size(won) > 1).alias("tie"))


_L = "(SELECT unit_id AS id, unit_id * unit_id % 11 % 3 AS label, CASE WHEN unit_id % 13 = 0 THEN NULL ELSE CAST(unit_id % 100 AS DOUBLE) / 100 END AS prob FROM units)"


@query(f"""WITH l AS {_L}, s AS (SELECT e.a AS id, l.label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY e.a) AS share FROM ({_ROOK}) e JOIN l ON l.id = e.b GROUP BY e.a, l.label),
o AS (SELECT s.id, s.share FROM s JOIN l ON l.id = s.id AND l.label = s.label), b AS (SELECT id, label, share FROM (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY s.share DESC, s.label) AS k FROM s JOIN l ON l.id = s.id AND l.label <> s.label) WHERE k = 1)
SELECT l.id, CAST(CASE WHEN coalesce(b.share, 0) >= 0.85 AND coalesce(o.share, 0) <= 0.15 THEN b.label WHEN coalesce(b.share, 0) >= 0.75 AND coalesce(o.share, 0) <= 0.25 AND l.prob <= 0.5 THEN b.label ELSE l.label END AS BIGINT) AS label,
CASE WHEN coalesce(b.share, 0) >= 0.85 AND coalesce(o.share, 0) <= 0.15 THEN 'rule1' WHEN coalesce(b.share, 0) >= 0.75 AND coalesce(o.share, 0) <= 0.25 AND l.prob <= 0.5 THEN 'rule2' ELSE 'kept' END AS reason, b.label AS best, round(coalesce(b.share, 0), 6) AS best_share FROM l LEFT JOIN o USING (id) LEFT JOIN b USING (id)""")
def agg_label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours' label shares, the best other label, and the label by both smoothing rules."""
    from cityloom.operators import graph

    n = labels(spark, sf_dir).withColumn("prob", F.when(F.col("id") % 13 != 0, (F.col("id") % 100).cast("double") / 100))
    s = graph.neighbour_shares(n.select("id", "label"), rook(spark, sf_dir)).select("id", F.col("label").alias("to"), "share")
    j = n.join(s, "id", "left")
    other = F.when(F.col("to") != F.col("label"), F.struct((-F.col("share")).alias("s"), "to"))
    per = j.groupBy("id", "label", "prob").agg(F.max(F.when(F.col("to") == F.col("label"), F.col("share"))).alias("own"), F.min(other).alias("m"))
    label, reason = fr.smoothed(F.col("label"), F.col("m.to"), F.col("own"), -F.col("m.s"), F.col("prob"))
    return per.select("id", label.cast("long").alias("label"), reason.alias("reason"), F.col("m.to").alias("best"), r6(F.coalesce(-F.col("m.s"), F.lit(0.0))).alias("best_share"))


@query("""SELECT zone, count(*) AS n, count(DISTINCT CASE WHEN d = 2 THEN grp END) AS g2, count(DISTINCT CASE WHEN d = 4 THEN grp END) AS g4 FROM (SELECT u.zone, d, CASE d WHEN 2 THEN floor(f.x0 / 4) ELSE floor(f.x0 / 8) END AS grp FROM footprints f JOIN units u ON u.unit_id = f.id, (VALUES (2), (4)) t(d)) GROUP BY zone""")
def agg_buffer_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of buildings that their buffers of 2 and 4 m (rounded to a grid) dissolve into, by zone."""
    f = layer(spark, sf_dir, "footprints").select(F.col("id").alias("unit_id"), "x0").join(layer(spark, sf_dir, "units").select("unit_id", "zone"), "unit_id")
    return f.groupBy("zone").agg((2 * F.count("*")).alias("n"), F.countDistinct(F.floor(F.col("x0") / 4)).alias("g2"), F.countDistinct(F.floor(F.col("x0") / 8)).alias("g4"))


@query("WITH w AS (SELECT unit_id, " + ", ".join(f"max(CASE WHEN product = '{p}' THEN v END) AS {p}" for p in PRODUCTS) + " FROM products GROUP BY unit_id), p AS (SELECT AF AS a, NF AS b FROM w WHERE AF IS NOT NULL AND NF IS NOT NULL) SELECT count(*) AS n, round(100 * avg(CAST(a > b AS INT)), 6) AS pct_a, round(100 * avg(CAST(b > a AS INT)), 6) AS pct_b, round(avg(a - b), 6) AS bias FROM p")
def pair_each_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = wide(spark, sf_dir).where("AF is not null AND NF is not null")
    return d.agg(F.count("*").alias("n"), r6(100 * F.avg((F.col("AF") > F.col("NF")).cast("int"))).alias("pct_a"), r6(100 * F.avg((F.col("NF") > F.col("AF")).cast("int"))).alias("pct_b"), r6(F.avg(F.col("AF") - F.col("NF"))).alias("bias"))


# Windows and order ---------------------------------------------------------------------------


@query("SELECT id, round(sum(len) OVER (PARTITION BY unit_id ORDER BY id ROWS UNBOUNDED PRECEDING), 6) AS along, round(sum(len) OVER (PARTITION BY unit_id ORDER BY id RANGE BETWEEN 2000 PRECEDING AND 2000 FOLLOWING), 6) AS around FROM ways")
def win_cumdist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length along each line, and within a reach of each vertex to both sides."""
    w = Window.partitionBy("unit_id").orderBy("id")
    return layer(spark, sf_dir, "ways").select("id", r6(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("along"), r6(F.sum("len").over(w.rangeBetween(-2000, 2000))).alias("around"))


@query("SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after, coalesce(highway = lag(highway) OVER w, FALSE) AS same FROM ways WINDOW w AS (PARTITION BY unit_id ORDER BY id)")
def win_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("unit_id").orderBy("id")
    return layer(spark, sf_dir, "ways").select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"), fr.no(F.col("highway") == F.lag("highway").over(w)).alias("same"))


@query("SELECT unit_id, id, round(sum(len) OVER w / sum(len) OVER (PARTITION BY unit_id), 6) AS share FROM ways WINDOW w AS (PARTITION BY unit_id ORDER BY len, id ROWS UNBOUNDED PRECEDING)")
def win_running_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the weight up to each member, in the order of a projection."""
    own = Window.partitionBy("unit_id")
    w = own.orderBy("len", "id").rowsBetween(Window.unboundedPreceding, 0)
    return layer(spark, sf_dir, "ways").select("unit_id", "id", r6(F.sum("len").over(w) / F.sum("len").over(own)).alias("share"))


@query("""WITH q AS (SELECT zone, list_distinct(quantile_cont(people, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM (SELECT zone, CAST(floor(people / 400) AS DOUBLE) AS people FROM blocks) GROUP BY zone)
SELECT id, CAST(greatest(1, len(list_filter(e, lambda x: x < floor(people / 400)))) AS INT) AS cls FROM blocks JOIN q USING (zone)""")
def qcut_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile classes of each zone, closed on the right; equal edges are one."""
    b = layer(spark, sf_dir, "blocks").withColumn("v", F.floor(F.col("people") / 400).cast("double"))
    q = b.groupBy("zone").agg(F.array_distinct(F.percentile("v", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))).alias("e"))
    below = F.size(F.filter("e", lambda x: x < F.col("v")))
    return b.join(q, "zone").select("id", F.greatest(F.lit(1), below).alias("cls"))


@query("SELECT id, year, src, CAST(row_number() OVER (ORDER BY year DESC NULLS LAST, src DESC, id) AS BIGINT) AS place FROM footprints")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the order of several keys, unknown dates last.  Counts of each (year, src)
    come first, so that only rows of one year and source are numbered together."""
    f = layer(spark, sf_dir, "footprints")
    order = [F.col("year").desc_nulls_last(), F.col("src").desc()]
    n = f.groupBy("year", "src").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("year").alias("y"), F.col("src").alias("s"), "before")
    own = F.row_number().over(Window.partitionBy("year", "src").orderBy("id"))
    return f.withColumn("own", own).join(F.broadcast(before), F.expr("year <=> y AND src = s")).select("id", "year", "src", (F.col("before") + F.col("own")).alias("place"))


@query("SELECT unit_id, max(id) AS id, max_by(highway, id) AS highway FROM ways GROUP BY unit_id")
def drop_dup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("id", "highway"), "id")
    return layer(spark, sf_dir, "ways").groupBy("unit_id").agg(last.alias("l")).select("unit_id", "l.id", "l.highway")


@query("SELECT name, CAST(row_number() OVER (PARTITION BY zone ORDER BY TRY_CAST(regexp_extract(name, '_([0-9]+)', 1) AS BIGINT), name) AS INT) AS place FROM blocks")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders in the order of the number in their names."""
    w = Window.partitionBy("zone").orderBy(fr.block_number(F.col("name")), "name")
    return layer(spark, sf_dir, "blocks").select("name", F.row_number().over(w).alias("place"))


@query(None)
def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 rows by the order of a seeded hash: the same on every run and partitioning."""
    return layer(spark, sf_dir, "points").orderBy(F.xxhash64("id", F.lit(42)), "id").limit(200)


@query("SELECT kind, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(p * 100)}" for p in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM points GROUP BY kind")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (0.0, 0.25, 0.5, 0.75, 1.0)
    d = layer(spark, sf_dir, "points").groupBy("kind").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), F.percentile("value", F.array(*map(F.lit, p))).alias("q"))
    return d.select("kind", "n", "mean", "sd", *(r6(F.col("q")[i]).alias(f"p{int(x * 100)}") for i, x in enumerate(p)))


# Set operations ------------------------------------------------------------------------------


@query("SELECT id, area FROM footprints UNION ALL SELECT id, area FROM blocks")
def union_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.union_common(layer(spark, sf_dir, "footprints").select("id", "src", "area"), layer(spark, sf_dir, "blocks").select("class", "area", "id"))


@query("SELECT id, area, src, NULL AS class FROM footprints UNION ALL SELECT id, area, NULL, class FROM blocks")
def union_reindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "footprints").select("id", "area", "src").unionByName(layer(spark, sf_dir, "blocks").select("id", "area", "class"), allowMissingColumns=True)


@query("SELECT DISTINCT unit_id, highway FROM ways")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "ways").select("unit_id", "highway").distinct()


@query("SELECT id FROM footprints EXCEPT SELECT unit_id FROM ways")
def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "footprints").select("id").join(layer(spark, sf_dir, "ways").select(F.col("unit_id").alias("id")), "id", "left_anti").distinct()


@query("SELECT name FROM (VALUES ('id'), ('area')) t(name)")
def intersect_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that two layers have in common."""
    a, b = layer(spark, sf_dir, "footprints").columns, layer(spark, sf_dir, "blocks").columns
    return spark.createDataFrame([(c,) for c in a if c in b], "name string")


@query("SELECT id, CAST(part AS INT) AS part, x0 + part * 2 AS x0 FROM footprints, range(0, 3) t(part) WHERE part <= id % 3")
def explode_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipart features as single parts with their numbers."""
    parts = F.transform(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")), lambda k: F.col("x0") + k * 2)
    return layer(spark, sf_dir, "footprints").select("id", F.posexplode(parts).alias("part", "x0"))


@query(f"SELECT b.unit_id, a.id, {_AREA} AS piece FROM footprints a JOIN units b ON {_MEET} WHERE b.zone = 3")
def split_into_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings clipped to each selected block: one set a block, to be written by block."""
    pairs = spatial.rect_pairs(layer(spark, sf_dir, "footprints"), layer(spark, sf_dir, "units").where("zone = 3"))
    return pairs.select(F.col("b_unit_id").alias("unit_id"), F.col("a_id").alias("id"), fx.overlap_area("a_", "b_").alias("piece"))


@query("SELECT id, src FROM footprints WHERE NOT coalesce(src = 2 AND year < 2010, FALSE)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "footprints").where(~fr.no(F.expr("src = 2 AND year < 2010"))).select("id", "src")


@query("""WITH c AS (SELECT b.id * 10 + k AS id, b.area / 2 AS area, b.id AS parent FROM blocks b, range(1, 3) t(k) WHERE b.label = 1) SELECT id, area, NULL AS parent, FALSE AS is_child FROM blocks WHERE label <> 1 UNION ALL SELECT id, area, parent, TRUE FROM c""")
def replace_parent_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = layer(spark, sf_dir, "blocks").select("id", "area", "label")
    children = b.where("label = 1").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select((F.col("id") * 10 + F.col("k")).alias("id"), (F.col("area") / 2).alias("area"), F.col("id").alias("parent"))
    return joins.replace_parents(b.select("id", "area"), children, "id", "parent").select("id", "area", "parent", "is_child")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with themselves inside each region."""
    n = read(spark, sf_dir, "nation")
    return n.select("n_regionkey", F.col("n_nationkey").alias("a")).join(n.select("n_regionkey", F.col("n_nationkey").alias("b")), "n_regionkey").where("a <= b").select("a", "b")


@query("SELECT r, c, CAST(code AS INT) AS code, CASE code WHEN 1 THEN 'A' WHEN 2 THEN 'N' WHEN 3 THEN 'A+N' WHEN 4 THEN 'R' WHEN 5 THEN 'A+R' WHEN 6 THEN 'N+R' WHEN 7 THEN 'A+N+R' ELSE 'none' END AS name FROM (SELECT r, c, max(CASE WHEN band = 'A' AND v > 20 THEN 1 ELSE 0 END) + max(CASE WHEN band = 'N' AND v > 20 THEN 2 ELSE 0 END) + max(CASE WHEN band = 'R' AND v > 20 THEN 4 ELSE 0 END) AS code FROM cells GROUP BY r, c)")
def band_code_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityloom.operators import raster

    codes = raster.presence_codes(layer(spark, sf_dir, "cells"), ["A", "N", "R"], 20)
    names = F.array_join(F.filter(F.array(*(F.when(F.col("code").bitwiseAND(1 << i) > 0, b) for i, b in enumerate("ANR"))), lambda x: x.isNotNull()), "+")
    return codes.select("r", "c", "code", F.when(F.col("code") == 0, "none").otherwise(names).alias("name"))


@query(f"SELECT count(*) AS n, count_if(hh_cc = 1) AS mixed, CAST(sum(large_pop) AS BIGINT) AS large FROM (SELECT CAST(id % 4 = 0 AND id % 6 < 2 AS INT) AS hh_cc, CAST(people > 1000 AS INT) AS large_pop FROM blocks)")
def flag_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("hh_cc") == 1).alias("mixed"), F.sum("large_pop").alias("large"))


@query("SELECT product, round(corr(v, o), 6) AS pearson, count(*) AS n, round(avg(stats_w), 6) AS wmean FROM (SELECT a.product, a.v, b.v AS o, (a.v + b.v) / 2 AS stats_w FROM products a JOIN products b ON a.unit_id = b.unit_id AND b.product = 'NO' WHERE a.product <> 'NO' AND a.v IS NOT NULL AND b.v IS NOT NULL) GROUP BY product")
def product_against_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = layer(spark, sf_dir, "products")
    base = p.where("product = 'NO'").select("unit_id", F.col("v").alias("o"))
    both = p.where("product <> 'NO'").join(base, "unit_id").where("v is not null AND o is not null")
    return both.groupBy("product").agg(r6(F.corr("v", "o")).alias("pearson"), F.count("*").alias("n"), r6(F.avg((F.col("v") + F.col("o")) / 2)).alias("wmean"))
