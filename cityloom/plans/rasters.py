"""Queries of rasters: zones, resampling, kernels, patches, masks and stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import columns as fx
from cityloom.operators import raster, spatial
from cityloom.plans.places import _AREA, _MEET, _RECTS, _WIDTH
from cityloom.plans.register import query, r6, read
from cityloom.sources.layers import layer

_SUB = "SELECT DISTINCT sy.r, sx.c FROM footprints, unnest(range(CAST(ceil((x0 - 2) / 4) AS BIGINT), CAST(ceil((x1 - 2) / 4) AS BIGINT))) AS sx(c), unnest(range(CAST(ceil((y0 - 2) / 4) AS BIGINT), CAST(ceil((y1 - 2) / 4) AS BIGINT))) AS sy(r)"


@query(f"SELECT CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, count(*) / 16 AS fraction FROM ({_SUB}) GROUP BY 1, 2")
def ras_grid_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a grid snapped to 16 m, with the share of their 4 m parts whose centre is built over."""
    along = lambda lo, hi: F.explode(F.sequence(F.ceil((F.col(lo) - 2) / 4), F.ceil((F.col(hi) - 2) / 4) - 1))
    some = layer(spark, sf_dir, "footprints").where("ceil((x1 - 2) / 4) > ceil((x0 - 2) / 4) AND ceil((y1 - 2) / 4) > ceil((y0 - 2) / 4)")
    parts = some.withColumn("c", along("x0", "x1")).withColumn("r", along("y0", "y1")).select("r", "c").distinct()
    return parts.groupBy(F.floor(F.col("r") / 4).alias("r"), F.floor(F.col("c") / 4).alias("c")).agg((F.count("*") / 16).alias("fraction"))


@query(f"WITH k AS ({_RECTS}) SELECT b.unit_id, a.band, round(sum(a.v * {_AREA}) / sum({_AREA}), 6) AS mean, round(sum(a.v * {_AREA} / 256), 6) AS total FROM k a JOIN units b ON {_MEET} GROUP BY b.unit_id, a.band")
def ras_zonal_mean_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.rect_pairs(raster.cell_rects(layer(spark, sf_dir, "cells"), 16), layer(spark, sf_dir, "units")).withColumn("s", fx.overlap_area("a_", "b_"))
    weighted = F.sum(F.col("a_v") * F.col("s"))
    return pairs.groupBy(F.col("b_unit_id").alias("unit_id"), F.col("a_band").alias("band")).agg(r6(weighted / F.sum("s")).alias("mean"), r6(F.sum(F.col("a_v") * F.col("s") / 256)).alias("total"))


@query("SELECT u.unit_id, k.band, count(*) AS n, sum(k.v) AS total, round(avg(k.v), 6) AS mean FROM cells k JOIN units u ON k.c * 16 + 8 >= u.x0 AND k.c * 16 + 8 < u.x1 AND k.r * 16 + 8 >= u.y0 AND k.r * 16 + 8 < u.y1 GROUP BY u.unit_id, k.band")
def ras_zonal_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by the unit that holds their centre."""
    mid = lambda c: (F.col(c) * 16 + 8).cast("double")
    k = layer(spark, sf_dir, "cells").select("band", "v", mid("c").alias("x"), mid("r").alias("y"))
    return spatial.points_in(k, layer(spark, sf_dir, "units")).groupBy(F.col("b_unit_id").alias("unit_id"), "band").agg(F.count("*").alias("n"), F.sum("v").alias("total"), r6(F.avg("v")).alias("mean"))


_T = "(SELECT a.i AS tr, b.i AS tc FROM range(0, 1000) a(i), range(0, 1000) b(i), (SELECT max(r) AS mr, max(c) AS mc FROM cells) WHERE a.i * 24 < mr * 16 + 16 AND b.i * 24 < mc * 16 + 16)"


@query(f"SELECT band, tr AS r, tc AS c, v FROM {_T} JOIN cells k ON k.r = CAST(floor((tr * 24 + 12) / 16) AS BIGINT) AND k.c = CAST(floor((tc * 24 + 12) / 16) AS BIGINT)")
def ras_resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 m to 24 m cells: the value under each new centre."""
    return raster.resample_nearest(layer(spark, sf_dir, "cells"), 16, 24)


_OVER = "least(k.{p} * 16 + 16, t{p} * 24 + 24) - greatest(k.{p} * 16, t{p} * 24)"


@query(f"SELECT band, tr AS r, tc AS c, round(sum(v * w) / sum(w), 6) AS v, round(sum(w) / 576, 6) AS known FROM (SELECT band, tr, tc, v, ({_OVER.format(p='r')}) * ({_OVER.format(p='c')}) AS w FROM {_T} JOIN cells k ON k.r * 16 < tr * 24 + 24 AND tr * 24 < k.r * 16 + 16 AND k.c * 16 < tc * 24 + 24 AND tc * 24 < k.c * 16 + 16) GROUP BY band, tr, tc")
def ras_resample_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16 m to 24 m cells: means by shared area, and the share that is known."""
    return raster.resample_average(layer(spark, sf_dir, "cells"), 16, 24).withColumns({"v": r6("v"), "known": r6("known")})


@query("""SELECT id, round(sum(w * v) / sum(w), 6) AS v FROM (SELECT p.id, k.v, (1 - abs(p.x / 16 - 0.5 - k.c)) * (1 - abs(p.y / 16 - 0.5 - k.r)) AS w FROM points p JOIN cells k ON k.band = 'A' AND k.c BETWEEN floor(p.x / 16 - 0.5) AND floor(p.x / 16 - 0.5) + 1 AND k.r BETWEEN floor(p.y / 16 - 0.5) AND floor(p.y / 16 - 0.5) + 1) WHERE w > 0 GROUP BY id""")
def ras_resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at points between the centres of four cells; missing ones give their weight to the others."""
    return raster.sample_bilinear(layer(spark, sf_dir, "cells").where("band = 'A'"), layer(spark, sf_dir, "points"), 16).select("id", r6("v").alias("v"))


@query("SELECT a.band, a.r, a.c, round(avg(b.v), 6) AS mean, count(*) AS n FROM cells a JOIN cells b ON a.band = b.band AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 AND pow(a.r - b.r, 2) + pow(a.c - b.c, 2) <= 6.25 GROUP BY a.band, a.r, a.c")
def ras_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over a circle of 40 m around each cell; missing cells are skipped."""
    cells = layer(spark, sf_dir, "cells")
    sums = raster.spread(cells, raster.circle(2.5)).groupBy("band", "r", "c").agg(F.sum("v").alias("t"), F.count("*").alias("n"))
    return sums.join(cells.select("band", "r", "c"), ["band", "r", "c"], "left_semi").select("band", "r", "c", r6(F.col("t") / F.col("n")).alias("mean"), "n")


@query("SELECT a.r, a.c, sum(b.v) AS total, round(avg(b.v), 6) AS mean, round(quantile_cont(b.v, 0.9), 6) AS p90, round(count(*) / (9 * 256 / 10000.0), 6) AS density FROM cells a JOIN cells b ON a.band = 'A' AND b.band = 'A' AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.r, a.c")
def ras_focal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = layer(spark, sf_dir, "cells").where("band = 'A'")
    around = raster.spread(cells, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]).groupBy("r", "c").agg(F.sum("v").alias("total"), r6(F.avg("v")).alias("mean"), r6(F.percentile("v", F.lit(0.9))).alias("p90"), r6(F.count("*") / 0.2304).alias("density"))
    return around.join(cells.select("r", "c"), ["r", "c"], "left_semi")


_HIGH = 60
_PATCH = f"""WITH RECURSIVE h AS (SELECT r, c, v FROM cells WHERE band = 'A' AND v > {_HIGH}), e AS (SELECT a.r * {_WIDTH} + a.c AS a, b.r * {_WIDTH} + b.c AS b FROM h a JOIN h b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
t AS (SELECT r * {_WIDTH} + c AS id, r * {_WIDTH} + c AS p FROM h UNION SELECT e.b, t.p FROM t JOIN e ON e.a = t.id), m AS (SELECT id, min(p) AS patch FROM t GROUP BY id)"""


def high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "cells").where(f"band = 'A' AND v > {_HIGH}").select("r", "c", "v")


@query(f"{_PATCH} SELECT patch, count(*) AS n, round(sum(CASE WHEN (r + c) % 5 = 0 THEN 0.5 ELSE 1 END) * 256 / 1000000, 6) AS km2 FROM m JOIN h ON h.r * {_WIDTH} + h.c = m.id GROUP BY patch HAVING count(*) >= 2 AND sum(CASE WHEN (r + c) % 5 = 0 THEN 0.5 ELSE 1 END) * 256 / 1000000 >= 0.0005")
def ras_patches_min10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of enough cells and enough area inside the city, of which some cells lie half outside."""
    h = high(spark, sf_dir)
    inside = F.sum(F.when((F.col("r") + F.col("c")) % 5 == 0, 0.5).otherwise(1.0)) * 256 / 1000000
    per = raster.patches(h, _WIDTH).groupBy("patch").agg(F.count("*").alias("n"), inside.alias("km2"))
    return per.where("n >= 2 AND km2 >= 0.0005").withColumn("km2", r6("km2"))


@query(f"""{_PATCH}, g AS (SELECT patch, r, c FROM m JOIN h ON h.r * {_WIDTH} + h.c = m.id) SELECT patch, CAST(count(*) * 256 AS DOUBLE) AS area, CAST(sum(16 * (4 - (SELECT count(*) FROM h x WHERE abs(x.r - g.r) + abs(x.c - g.c) = 1))) AS DOUBLE) AS perimeter FROM g GROUP BY patch""")
def ras_polygonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches as rings, whose areas (holes less) and lengths are measured on the rings."""
    h = high(spark, sf_dir)
    return raster.measure_rings(raster.polygonize(raster.patches(h, _WIDTH), 16))


@query("SELECT r, c, CASE WHEN coalesce(max(CASE WHEN band = 'A' THEN v END), 0) > 0 AND coalesce(max(CASE WHEN band = 'N' THEN v END), 0) = 0 THEN 'new' WHEN coalesce(max(CASE WHEN band = 'N' THEN v END), 0) > 0 THEN 'old' ELSE 'none' END AS state FROM cells GROUP BY r, c")
def ras_new_vs_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = lambda b: F.coalesce(F.max(F.when(F.col("band") == b, F.col("v"))), F.lit(0.0))
    return layer(spark, sf_dir, "cells").groupBy("r", "c").agg(F.when((top("A") > 0) & (top("N") == 0), "new").when(top("N") > 0, "old").otherwise("none").alias("state"))


@query("SELECT r, c, v FROM cells JOIN (SELECT r, c, greatest(coalesce(max(CASE WHEN band = 'A' THEN v END), 0), coalesce(max(CASE WHEN band = 'N' THEN v END), 0)) AS mask FROM cells GROUP BY r, c) USING (r, c) WHERE band = 'R' AND mask < 40")
def ras_mask_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of one raster where the larger of two masks is under the threshold."""
    top = lambda b: F.coalesce(F.max(F.when(F.col("band") == b, F.col("v"))), F.lit(0.0))
    value = F.max(F.when(F.col("band") == "R", F.col("v")))
    per = layer(spark, sf_dir, "cells").groupBy("r", "c").agg(F.greatest(top("A"), top("N")).alias("mask"), value.alias("v"))
    return per.where("mask < 40 AND v is not null").select("r", "c", "v")


@query(f"SELECT DISTINCT h.r + i.i AS r, h.c + j.i AS c FROM (SELECT r, c FROM cells WHERE band = 'A' AND v > {_HIGH}) h, range(-2, 3) i(i), range(-2, 3) j(i)")
def ras_morph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High cells grown by two cells to all sides."""
    return raster.spread(high(spark, sf_dir), [(i, j) for i in range(-2, 3) for j in range(-2, 3)]).select("r", "c").distinct()


@query("SELECT r, c, max(CASE WHEN band = 'A' THEN v END) AS A, max(CASE WHEN band = 'N' THEN v END) AS N, max(CASE WHEN band = 'R' THEN v END) AS R_ FROM cells GROUP BY r, c")
def ras_band_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column a band; a band called like a coordinate gets an underscore."""
    one = lambda b: F.max(F.when(F.col("band") == b, F.col("v")))
    return layer(spark, sf_dir, "cells").groupBy("r", "c").agg(one("A").alias("A"), one("N").alias("N"), one("R").alias("R_"))


@query("SELECT band, r * 100000 + c AS id, CAST(c * 16 + 8 AS DOUBLE) AS x, CAST(r * 16 + 8 AS DOUBLE) AS y, v FROM cells WHERE v > 0")
def raster_to_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid = lambda c: (F.col(c) * 16 + 8).cast("double")
    return layer(spark, sf_dir, "cells").where("v > 0").select("band", (F.col("r") * 100000 + F.col("c")).alias("id"), mid("c").alias("x"), mid("r").alias("y"), "v")


@query("SELECT k.r, k.c, k.band, u.unit_id FROM cells k JOIN units u ON u.x0 = floor(k.c * 16 / 50) * 50 AND u.y0 = floor(k.r * 16 / 50) * 50 WHERE k.band = 'R'")
def ras_fishnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the fishnet square that holds their corner."""
    at = lambda c: (F.floor(F.col(c) * 16 / 50) * 50).cast("double")
    k = layer(spark, sf_dir, "cells").where("band = 'R'").select("r", "c", "band", at("c").alias("x0"), at("r").alias("y0"))
    return k.join(layer(spark, sf_dir, "units").select("unit_id", "x0", "y0"), ["x0", "y0"]).select("r", "c", "band", "unit_id")


@query("SELECT CAST(o_custkey % 40 AS BIGINT) AS cell, CAST(month(o_orderdate) AS INT) AS month, count(*) AS valid, count_if(o_totalprice > 100000) AS positive FROM orders GROUP BY 1, 2")
def gee_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and positive observations of each cell by month."""
    return read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("cell"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("valid"), F.count_if(F.col("o_totalprice") > 100000).alias("positive"))


@query("""WITH m AS (SELECT o_custkey % 40 AS cell, year(o_orderdate) AS y, month(o_orderdate) AS mo, max(o_totalprice) > 180000 AS wet FROM orders GROUP BY 1, 2, 3)
SELECT CAST(cell AS BIGINT) AS cell, CAST(floor(y / 5) * 5 AS BIGINT) AS period, count(*) AS valid, count_if(wet) AS water, round(count_if(wet) / count(*), 6) AS occurrence, bool_or(wet) AS anytime, bool_and(wet) AS permanent FROM m GROUP BY 1, 2""")
def ras_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water months over valid months of each cell in periods of five years."""
    m = read(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 40).alias("cell"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("mo")).agg((F.max("o_totalprice") > 180000).alias("wet"))
    wet = F.count_if("wet")
    return m.groupBy("cell", (F.floor(F.col("y") / 5) * 5).alias("period")).agg(F.count("*").alias("valid"), wet.alias("water"), r6(wet / F.count("*")).alias("occurrence"), F.bool_or("wet").alias("anytime"), F.bool_and("wet").alias("permanent"))


@query("""SELECT k.r, k.c, CAST(CASE WHEN u.zone IS NULL OR u.zone = 6 THEN 255 ELSE code END AS INT) AS code FROM (SELECT r, c, max(CASE WHEN band = 'A' AND v > 20 THEN 1 ELSE 0 END) + max(CASE WHEN band = 'N' AND v > 20 THEN 2 ELSE 0 END) + max(CASE WHEN band = 'R' AND v > 20 THEN 4 ELSE 0 END) AS code FROM cells GROUP BY r, c) k
LEFT JOIN units u ON u.x0 = floor((k.c * 16 + 8) / 50) * 50 AND u.y0 = floor((k.r * 16 + 8) / 50) * 50""")
def ras_overlay_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bit for each source that shows water; 255 outside the city."""
    codes = raster.presence_codes(layer(spark, sf_dir, "cells"), ["A", "N", "R"], 20)
    at = lambda c: (F.floor((F.col(c) * 16 + 8) / 50) * 50).cast("double")
    j = codes.withColumns({"x0": at("c"), "y0": at("r")}).join(layer(spark, sf_dir, "units").select("x0", "y0", "zone"), ["x0", "y0"], "left")
    return j.select("r", "c", F.when(F.col("zone").isNull() | (F.col("zone") == 6), 255).otherwise(F.col("code")).cast("int").alias("code"))


@query("SELECT a.r, a.c, CAST(sqrt(min(pow(a.r - b.r, 2) + pow(a.c - b.c, 2))) * 16 AS DOUBLE) AS dist FROM cells a JOIN cells b ON a.band = 'N' AND b.band = 'N' AND b.v > 90 AND abs(a.r - b.r) <= 3 AND abs(a.c - b.c) <= 3 WHERE pow(a.r - b.r, 2) + pow(a.c - b.c, 2) <= 9 GROUP BY a.r, a.c")
def ras_distance_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest target cell, to three cells away."""
    cells = layer(spark, sf_dir, "cells").where("band = 'N'")
    far = raster.spread(cells.where("v > 90"), raster.circle(3), keep="d").groupBy("r", "c").agg(F.min("d").alias("dist"))
    return far.join(cells.select("r", "c"), ["r", "c"], "left_semi").select("r", "c", (F.col("dist") * 16).alias("dist"))
