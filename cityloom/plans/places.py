"""Queries of neighbourhoods, zonal statistics, raster patches, rings and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityloom.functions import columns as fx
from cityloom.functions import rings
from cityloom.operators import graph, raster, spatial
from cityloom.plans.register import query, r6
from cityloom.sources.layers import layer

_MEET = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_AREA = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_RECTS = "SELECT *, c * 16::DOUBLE AS x0, r * 16::DOUBLE AS y0, c * 16::DOUBLE + 16 AS x1, r * 16::DOUBLE + 16 AS y1 FROM cells"
_ROOK = "SELECT a.unit_id AS a, b.unit_id AS b FROM units a JOIN units b ON abs(a.x0 - b.x0) + abs(a.y0 - b.y0) = 50"
#: A cell is high over this; cell numbers are r * _WIDTH + c, with room for any raster.
_HIGH, _WIDTH = 60, 1 << 20

# Neighbourhoods ------------------------------------------------------------------------------


def rook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that share a side, in both directions, by an equi join on corners."""
    u = layer(spark, sf_dir, "units")
    a = u.select(F.col("unit_id").alias("a"), F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x0").alias("x"), F.col("y1").alias("y")))).alias("at"))
    e = a.join(u.select(F.col("unit_id").alias("b"), F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")).alias("at")), "at").select("a", "b")
    return e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "units").select(F.col("unit_id").alias("id"), (F.col("unit_id") * F.col("unit_id") % 11 % 3).alias("label"))


_LABELS = "SELECT unit_id AS id, unit_id * unit_id % 11 % 3 AS label FROM units"


@query(f"""WITH RECURSIVE l AS ({_LABELS}), e AS (SELECT e.a, e.b FROM ({_ROOK}) e JOIN l x ON x.id = e.a JOIN l y ON y.id = e.b WHERE x.label = y.label),
t AS (SELECT id, id AS c FROM l UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.id) SELECT id, min(c) AS component FROM t GROUP BY id""")
def same_label_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = labels(spark, sf_dir)
    e = rook(spark, sf_dir).join(n.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(n.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    return graph.components(n, e.where("la = lb").select("a", "b"))


@query(f"""WITH l AS ({_LABELS}), s AS (SELECT e.a AS id, l.label AS to_label, count(*) / sum(count(*)) OVER (PARTITION BY e.a) AS share FROM ({_ROOK}) e JOIN l ON l.id = e.b GROUP BY e.a, l.label),
b AS (SELECT id, to_label FROM s WHERE share >= 0.6) SELECT l.id, CAST(coalesce(b.to_label, l.label) AS BIGINT) AS label, b.to_label IS NOT NULL AND b.to_label <> l.label AS changed FROM l LEFT JOIN b ON b.id = l.id""")
def label_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit takes the label of 0.6 or more of its neighbours."""
    n = labels(spark, sf_dir)
    strong = graph.neighbour_shares(n, rook(spark, sf_dir)).where("share >= 0.6").select("id", F.col("label").alias("to"))
    to = F.coalesce("to", "label")
    return n.join(strong, "id", "left").select("id", to.cast("long").alias("label"), (to != F.col("label")).alias("changed"))


@query(f"""WITH g AS (SELECT count(*) AS n, avg(population) AS m, stddev_pop(population) AS s FROM units),
k AS (SELECT a AS id, sum(u.population) AS t, count(*) AS w FROM ({_ROOK} UNION ALL SELECT unit_id, unit_id FROM units) e JOIN units u ON u.unit_id = e.b GROUP BY a),
z AS (SELECT id, (t - m * w) / (s * sqrt((n * w - w * w) / (n - 1))) AS z FROM k, g)
SELECT id, round(z, 6) AS z, CAST(sign(z) * CASE WHEN abs(z) > 2.576 THEN 3 WHEN abs(z) > 1.96 THEN 2 WHEN abs(z) > 1.645 THEN 1 ELSE 0 END AS INT) AS bin FROM z""")
def hotspot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = layer(spark, sf_dir, "units").withColumnRenamed("unit_id", "id")
    return graph.hot_spots(units, rook(spark, sf_dir), F.col("population")).withColumn("z", r6("z"))


@query("""SELECT id, t_id, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, t_id) AS rank FROM
(SELECT unit_id AS id, p.id AS t_id, sqrt(pow(x0 + 25 - x, 2) + pow(y0 + 25 - y, 2)) AS dist FROM units, points p)) WHERE rank <= 5""")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = layer(spark, sf_dir, "units").select(F.col("unit_id").alias("id"), (F.col("x0") + 25).alias("x"), (F.col("y0") + 25).alias("y"))
    return spatial.nearest(centres, layer(spark, sf_dir, "points"), 5, 16.0).withColumn("dist", r6("dist"))


@query(f"WITH k AS ({_RECTS}) SELECT x.r, x.c, round(sqrt(min(pow(x.x0 - y.x0, 2) + pow(x.y0 - y.y0, 2))), 6) AS dist FROM k x, k y WHERE x.band = 'A' AND y.band = 'A' AND y.v > {_HIGH} GROUP BY x.r, x.c")
def grid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from each cell to the nearest high one."""
    k = raster.cell_rects(layer(spark, sf_dir, "cells").where("band = 'A'"), 16).select((F.col("r") * _WIDTH + F.col("c")).alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"), "v")
    near = spatial.nearest(k, k.where(F.col("v") > _HIGH), 1, 32.0)
    return near.select(F.floor(F.col("id") / _WIDTH).alias("r"), (F.col("id") % _WIDTH).alias("c"), r6("dist").alias("dist"))


@query("SELECT id, x, y FROM points p WHERE NOT EXISTS (SELECT 1 FROM footprints f WHERE pow(greatest(f.x0 - p.x, 0, p.x - f.x1), 2) + pow(greatest(f.y0 - p.y, 0, p.y - f.y1), 2) <= 16)")
def missing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with no building within 4 m."""
    p = layer(spark, sf_dir, "points")
    f = layer(spark, sf_dir, "footprints").select(*((F.col(c) - 4).alias(c) for c in ("x0", "y0")), *((F.col(c) + 5).alias(c) for c in ("x1", "y1")))
    gap = lambda c: F.greatest(F.col(f"b_{c}0") + 4 - F.col(c), F.lit(0.0), F.col(c) - F.col(f"b_{c}1") + 5)
    near = spatial.points_in(p, f).where(F.pow(gap("x"), 2) + F.pow(gap("y"), 2) <= 16).select("id")
    return p.join(near, "id", "left_anti").select("id", "x", "y")


# Zones and rasters ---------------------------------------------------------------------------


@query(f"WITH k AS ({_RECTS}) SELECT b.unit_id, a.band, round(sum(a.v * {_AREA} / 256), 6) AS total, round(sum({_AREA}) / 2500, 6) AS covered, sum({_AREA}) / 2500 >= 0.95 AS valid FROM k a JOIN units b ON {_MEET} GROUP BY b.unit_id, a.band")
def zonal_exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by the covered fraction of each cell; units of which 0.95 is known are valid."""
    k = raster.cell_rects(layer(spark, sf_dir, "cells"), 16)
    pairs = spatial.rect_pairs(k, layer(spark, sf_dir, "units")).withColumn("shared", fx.overlap_area("a_", "b_"))
    covered = F.sum("shared") / 2500
    return pairs.groupBy(F.col("b_unit_id").alias("unit_id"), F.col("a_band").alias("band")).agg(r6(F.sum(F.col("a_v") * F.col("shared") / 256)).alias("total"), r6(covered).alias("covered"), (covered >= 0.95).alias("valid"))


_RASTER = """SELECT cy.r, cx.c, count(*) AS touched, CAST(sum(CASE WHEN c * 16 + 8 >= x0 AND c * 16 + 8 < x1 AND r * 16 + 8 >= y0 AND r * 16 + 8 < y1 THEN 1 ELSE 0 END) AS BIGINT) AS centred, max(id) AS last
FROM footprints, unnest(range(CAST(floor(x0 / 16) AS BIGINT), CAST(ceil(x1 / 16) AS BIGINT))) AS cx(c), unnest(range(CAST(floor(y0 / 16) AS BIGINT), CAST(ceil(y1 / 16) AS BIGINT))) AS cy(r) GROUP BY cy.r, cx.c"""


@query(_RASTER)
def footprint_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rasterize(layer(spark, sf_dir, "footprints"), 16)


@query(f"WITH b AS ({_RASTER}) SELECT r, c, v FROM cells ANTI JOIN b USING (r, c) WHERE band = 'A' AND v > 0")
def missing_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive cells that no building touches."""
    built = raster.rasterize(layer(spark, sf_dir, "footprints"), 16)
    return layer(spark, sf_dir, "cells").where("band = 'A' AND v > 0").join(built, ["r", "c"], "left_anti").select("r", "c", "v")


@query(f"""WITH RECURSIVE h AS (SELECT r, c, v FROM cells WHERE band = 'A' AND v > {_HIGH}), e AS (SELECT a.r * {_WIDTH} + a.c AS a, b.r * {_WIDTH} + b.c AS b FROM h a JOIN h b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
t AS (SELECT r * {_WIDTH} + c AS id, r * {_WIDTH} + c AS p FROM h UNION SELECT e.b, t.p FROM t JOIN e ON e.a = t.id), m AS (SELECT id, min(p) AS patch FROM t GROUP BY id)
SELECT patch, count(*) AS n, sum(v) AS total, CAST(rank() OVER (ORDER BY sum(v) DESC, patch) AS INT) AS place FROM m JOIN h ON h.r * {_WIDTH} + h.c = m.id CROSS JOIN (SELECT max(r) AS mr, max(c) AS mc FROM cells) GROUP BY patch HAVING count(*) >= 2 AND bool_and(r > 0 AND r < mr AND c > 0 AND c < mc) ORDER BY place LIMIT 20""")
def gap_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 patches of two high cells or more, off the edge, with the largest sums."""
    cells = layer(spark, sf_dir, "cells")
    high = cells.where(f"band = 'A' AND v > {_HIGH}").select("r", "c", "v")
    edge = F.broadcast(cells.agg(F.max("r").alias("mr"), F.max("c").alias("mc")))  # one row
    inner = F.bool_and((F.col("r") > 0) & (F.col("r") < F.col("mr")) & (F.col("c") > 0) & (F.col("c") < F.col("mc")))
    sums = raster.patches(high, _WIDTH).join(high, ["r", "c"]).crossJoin(edge).groupBy("patch").agg(F.count("*").alias("n"), F.sum("v").alias("total"), inner.alias("inner"))
    kept = sums.where("n >= 2 AND inner").drop("inner").orderBy(F.desc("total"), "patch").limit(20)
    return kept.withColumn("place", F.rank().over(Window.orderBy(F.desc("total"), "patch")))


@query("""WITH k AS (SELECT r, c, coalesce(max(CASE WHEN band = 'A' THEN v END) > 30, FALSE) AS ref, coalesce(max(CASE WHEN band = 'N' THEN v END) > 30, FALSE) AS got FROM cells GROUP BY r, c),
s AS (SELECT count_if(ref AND got) AS tp, count_if(got AND NOT ref) AS fp, count_if(ref AND NOT got) AS fn FROM k)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fp + fn, 0), 6) AS iou FROM s""")
def extent_f1_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda b: F.coalesce(F.max(F.when(F.col("band") == b, F.col("v"))) > 30, F.lit(False))
    ref, got = F.col("ref"), F.col("got")
    k = layer(spark, sf_dir, "cells").groupBy("r", "c").agg(on("A").alias("ref"), on("N").alias("got"))
    s = k.agg(F.count_if(ref & got).alias("tp"), F.count_if(got & ~ref).alias("fp"), F.count_if(ref & ~got).alias("fn"))
    tp, wrong = F.col("tp"), F.col("fp") + F.col("fn")
    return s.select("tp", "fp", "fn", r6(F.try_divide(2 * tp, 2 * tp + wrong)).alias("f1"), r6(F.try_divide(tp, tp + wrong)).alias("iou"))


@query("SELECT u.unit_id, count(*) AS n, sum(least(f.x1, u.x1) - greatest(f.x0, u.x0)) AS len FROM footprints f JOIN units u ON f.x0 < u.x1 AND u.x0 < f.x1 AND f.y0 >= u.y0 AND f.y0 < u.y1 GROUP BY u.unit_id")
def line_length_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layer(spark, sf_dir, "footprints").select("id", "x0", "x1", F.col("y0").alias("y"))
    return spatial.lines_in(lines, layer(spark, sf_dir, "units")).groupBy(F.col("b_unit_id").alias("unit_id")).agg(F.count("*").alias("n"), F.sum("len").alias("len"))


# Rings and grids -----------------------------------------------------------------------------


@query("""SELECT id, (x1 - x0) * (y1 - y0) / 2 AS area, round(x1 - x0 + y1 - y0 + sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)), 6) AS perimeter, round((2 * x0 + x1) / 3, 6) AS cx, round((2 * y0 + y1) / 3, 6) AS cy,
least(x1 - x0, y1 - y0) AS penalty, TRUE AS inside FROM footprints""")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right triangles over two sides of each footprint."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    f = layer(spark, sf_dir, "footprints").select("id", F.array(p("x0", "y0"), p("x1", "y0"), p("x0", "y1")).alias("ring"))
    f = f.withColumns({"cx": rings.centroid(F.col("ring"), "x"), "cy": rings.centroid(F.col("ring"), "y")})
    ring = F.col("ring")
    return f.select("id", rings.area(ring).alias("area"), r6(rings.perimeter(ring)).alias("perimeter"), r6("cx").alias("cx"), r6("cy").alias("cy"), r6(rings.orientation_penalty(ring, 0.0)).alias("penalty"), rings.holds(ring, F.col("cx"), F.col("cy")).alias("inside"))


@query("""WITH s AS (SELECT sqrt(2 * 40000 / (3 * sqrt(3))) AS side) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(i * 1.5 * side, 6) AS x, round((j + i % 2 / 2) * sqrt(3) * side, 6) AS y
FROM s, (SELECT max(x1) AS w, max(y1) AS h FROM units), range(0, 1000) a(i), range(0, 1000) b(j) WHERE i < ceil(w / (1.5 * side)) + 1 AND j < ceil(h / (sqrt(3) * side)) + 1""")
def hex_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of hexagons of 4 ha over the extent of the units."""
    w, h = layer(spark, sf_dir, "units").agg(F.max("x1"), F.max("y1")).first()
    return spatial.hex_grid(spark, w or 0, h or 0, 40000).withColumns({"x": r6("x"), "y": r6("y")})


@query("""WITH e AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM cells) SELECT CAST(i AS INT) AS row, CAST(j AS INT) AS col, CAST(i * 24 AS INT) AS y, CAST(j * 24 AS INT) AS x, CAST(greatest(0, i * 24 + 32 - h) AS INT) AS pad_y, CAST(greatest(0, j * 24 + 32 - w) AS INT) AS pad_x
FROM e, range(0, 10000) a(i), range(0, 10000) b(j) WHERE (i = 0 OR i * 24 + 8 < h) AND (j = 0 OR j * 24 + 8 < w)""")
def raster_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 32 cells that share 8 with their neighbours, over the raster, with the padding of the last ones."""
    h, w = layer(spark, sf_dir, "cells").agg(F.max("r") + 1, F.max("c") + 1).first()
    pad = lambda at, n: F.greatest(F.lit(0), F.col(at) + 32 - n).cast("int")
    return raster.tiles(spark, w or 0, h or 0, 32, 8).withColumns({"pad_y": pad("y", h or 0), "pad_x": pad("x", w or 0)})


# Runs, votes and summaries -------------------------------------------------------------------


_KEY = "round((x0 + x1) / 2, 2) AS kx, round((y0 + y1) / 2, 2) AS ky, round((x1 - x0) * (y1 - y0), 1) AS ka, round(2 * (x1 - x0 + y1 - y0), 1) AS kp"


@query(f"""WITH o AS (SELECT unit_id + 1000 AS old_id, {_KEY} FROM (SELECT unit_id, x0, y0, x1 + CASE WHEN unit_id % 5 = 0 THEN 3 ELSE 0.0004 END AS x1, y1 FROM units)), n AS (SELECT unit_id, {_KEY} FROM units)
SELECT unit_id, old_id, old_id IS NULL AS changed FROM n LEFT JOIN o USING (kx, ky, ka, kp)""")
def geometry_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a former run with the same rounded centre, area and perimeter; the others have changed."""
    u = layer(spark, sf_dir, "units")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    key = lambda df: df.withColumns({"kx": F.round((F.col("x0") + F.col("x1")) / 2, 2), "ky": F.round((F.col("y0") + F.col("y1")) / 2, 2), "ka": F.round(w * h, 1), "kp": F.round(2 * (w + h), 1)})
    moved = u.withColumn("x1", F.col("x1") + F.when(F.col("unit_id") % 5 == 0, 3).otherwise(0.0004))
    old = key(moved).select((F.col("unit_id") + 1000).alias("old_id"), "kx", "ky", "ka", "kp")
    return key(u).join(old, ["kx", "ky", "ka", "kp"], "left").select("unit_id", "old_id", F.col("old_id").isNull().alias("changed"))


@query("""SELECT brand, vote, weight FROM (SELECT brand, src AS vote, sum(area) AS weight, row_number() OVER (PARTITION BY brand ORDER BY sum(area) DESC, src) AS k FROM footprints GROUP BY brand, src) WHERE k = 1""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = layer(spark, sf_dir, "footprints").groupBy("brand", "src").agg(F.sum("area").alias("weight"))
    return spatial.first_by(sums, "brand", F.desc("weight"), "src").select("brand", F.col("src").alias("vote"), "weight")


@query("SELECT src, year, CAST(grouping(src) * 2 + grouping(year) AS INT) AS level, count(*) AS n, sum(area) AS area, round(median(area), 6) AS med FROM footprints GROUP BY ROLLUP (src, year)")
def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "footprints").rollup("src", "year").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum("area").alias("area"), r6(F.median("area")).alias("med"))
