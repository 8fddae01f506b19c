"""Queries of scalars, statistics, windows, joins, rasters and greedy suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityloom.functions import columns as fx
from cityloom.operators import graph, joins, raster, spatial, stats
from cityloom.plans.register import oracle_sql, queries, query, r6, read  # noqa: F401
from cityloom.sources.layers import layer

PRODUCTS = ["AF", "NF", "NO", "RF"]


# Scalars and rules ---------------------------------------------------------------------------

_ACC = "concat(n_name, ' Éa-Ó ', n_nationkey)"


@query(f"SELECT n_nationkey, trim(regexp_replace(strip_accents(lower({_ACC})), '[^a-z0-9]+', ' ', 'g')) AS norm, replace(trim(regexp_replace(strip_accents(lower({_ACC})), '[^a-z0-9]+', ' ', 'g')), ' ', '_') AS slug FROM nation")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("n_name", F.lit(" Éa-Ó "), F.col("n_nationkey").cast("string"))
    return read(spark, sf_dir, "nation").select("n_nationkey", fx.normalize_text(name).alias("norm"), fx.slugify(name).alias("slug"))


@query("SELECT a.n_nationkey AS ka, b.n_nationkey AS kb FROM (SELECT n_nationkey, lower(n_name) AS n FROM nation) a JOIN (SELECT n_nationkey, left(lower(n_name), 5) AS n FROM nation) b ON contains(a.n, b.n) OR contains(b.n, a.n)")
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ka"), fx.normalize_text(F.col("n_name")).alias("na"))
    b = a.select(F.col("ka").alias("kb"), F.substring("na", 1, 5).alias("nb"))
    return joins.names_inside(a, "na", b, "nb").select("ka", "kb").union(joins.names_inside(b, "nb", a, "na").select("ka", "kb")).distinct()


@query("SELECT o_orderkey, CAST(o_orderkey % 90 AS INT) AS version FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 4 = 0")
def osm_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("w"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("@"), (F.col("o_orderkey") % 90).cast("string"))).otherwise(""))
    return read(spark, sf_dir, "orders").select("o_orderkey", fx.osm_version(key).alias("version"))


@query("SELECT id, CASE WHEN id % 3 = id % 5 THEN CAST(id % 3 AS VARCHAR) || '|z' ELSE concat(id % 3, '|z|', id % 5) END AS merged FROM footprints")
def pipe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda m: (F.col("id") % m).cast("string")
    return layer(spark, sf_dir, "footprints").select("id", fx.pipe_merge(F.concat(s(3), F.lit("|z")), F.concat(s(5), F.lit("|z"), F.lit(""))).alias("merged"))


@query("SELECT unit_id, 0.5 * greatest(0, least(1, population / 10 / 100)) + 0.5 * greatest(0, least(1, population / 1000)) AS intensity, CASE WHEN population <= 0 THEN NULL WHEN population <= 950 THEN 'low' WHEN population <= 1100 THEN 'mid' ELSE 'high' END AS band FROM units")
def settlement_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("population")
    return layer(spark, sf_dir, "units").select("unit_id", fx.settlement_intensity(p / 10, p).alias("intensity"), fx.classify_breaks(p, [950, 1100], ["low", "mid", "high"]).alias("band"))


@query("""SELECT id, CASE WHEN h1 BETWEEN 0.5 AND 100 THEN h1 WHEN h2 BETWEEN 0.5 AND 100 THEN h2 WHEN h3 BETWEEN 0.5 AND 100 THEN h3 END AS height,
CASE WHEN h1 BETWEEN 0.5 AND 100 THEN 'native' WHEN h2 BETWEEN 0.5 AND 100 THEN 'second' WHEN h3 BETWEEN 0.5 AND 100 THEN 'third' END AS source,
CAST(coalesce(CAST(h1 BETWEEN 0.5 AND 100 AS INT), 0) + coalesce(CAST(h2 BETWEEN 0.5 AND 100 AS INT), 0) + coalesce(CAST(h3 BETWEEN 0.5 AND 100 AS INT), 0) AS INT) AS n_valid FROM footprints""")
def height_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = [F.col(c) for c in ("h1", "h2", "h3")]
    ok = [c.between(0.5, 100) for c in h]
    return layer(spark, sf_dir, "footprints").select("id", fx.first_valid(h).alias("height"), F.when(ok[0], "native").when(ok[1], "second").when(ok[2], "third").alias("source"), fx.count_of_valid(h).alias("n_valid"))


_LONG = "SELECT id, h FROM footprints, unnest([h1, h2, h3]) AS t(h) WHERE h BETWEEN 0.5 AND 100"


@query(f"SELECT f.id, CASE WHEN g.n >= 2 THEN g.d END AS range_strict, g.d AS range_any FROM footprints f LEFT JOIN (SELECT id, count(*) AS n, max(h) - min(h) AS d FROM ({_LONG}) GROUP BY id) g USING (id)")
def height_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = [F.col(c) for c in ("h1", "h2", "h3")]
    return layer(spark, sf_dir, "footprints").select("id", fx.range_of_valid(h).alias("range_strict"), fx.range_of_valid(h, least=1).alias("range_any"))


@query("SELECT id, round(least(1, 4 * pi() * area / pow(2 * (x1 - x0 + y1 - y0), 2)), 6) AS compact, round(abs(x0 - y0) / greatest(abs(x0), abs(y0), 1), 6) AS diff, CAST(32600 + CASE WHEN y0 < 500 THEN 100 ELSE 0 END + floor((x0 / 3 - 160 + 180) / 6) + 1 AS INT) AS epsg FROM footprints")
def shape_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0 = F.col("x0"), F.col("y0")
    return layer(spark, sf_dir, "footprints").select("id", r6(fx.compactness(F.col("area"), 2 * (F.col("x1") - x0 + F.col("y1") - y0))).alias("compact"), r6(fx.rel_diff(x0, y0)).alias("diff"), fx.utm_epsg(x0 / 3 - 160, y0 - 500).alias("epsg"))


# Statistics ----------------------------------------------------------------------------------

_GROUPS = "SELECT *, unnest(CASE WHEN population < 1000 THEN ['all', 'small'] ELSE ['all', 'large'] END) AS grp FROM units"


@query(f"SELECT grp, count(population) AS n, median(population) AS median, quantile_cont(population, 0.25) AS q25, quantile_cont(population, 0.75) AS q75, quantile_cont(population, 0.75) - quantile_cont(population, 0.25) AS iqr, round(avg(population), 6) AS mean FROM ({_GROUPS}) GROUP BY grp")
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array(F.lit("all"), F.when(F.col("population") < 1000, "small").otherwise("large"))
    out = layer(spark, sf_dir, "units").withColumn("grp", F.explode(groups)).groupBy("grp").agg(*stats.quantiles("population"))
    return out.withColumn("mean", r6("mean"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "products").groupBy("unit_id").pivot("product", PRODUCTS).agg(F.max("v"))


_WIDE = "(SELECT unit_id, " + ", ".join(f"max(CASE WHEN product = '{p}' THEN v END) AS {p}" for p in PRODUCTS) + " FROM products GROUP BY unit_id)"
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS pa, '{b}' AS pb, {a} AS a, {b} AS b FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(PRODUCTS) for b in PRODUCTS[i + 1 :])
_RANKS = "SELECT *, rank() OVER (PARTITION BY pa, pb ORDER BY a) + (count(*) OVER (PARTITION BY pa, pb, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY pa, pb ORDER BY b) + (count(*) OVER (PARTITION BY pa, pb, b) - 1) / 2 AS rb FROM p"


@query(f"SELECT * FROM {_WIDE}")
def product_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir)


@query(f"WITH w AS {_WIDE}, p AS ({_PAIRS}), k AS ({_RANKS}) SELECT pa, pb, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM k GROUP BY pa, pb HAVING count(*) >= 3")
def product_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.correlations(wide(spark, sf_dir), PRODUCTS).withColumns({"pearson": r6("pearson"), "spearman": r6("spearman")})


@query(f"WITH w AS {_WIDE}, p AS ({_PAIRS}) SELECT pa, pb, count(*) AS n, round(avg(a - b), 6) AS bias, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse FROM p GROUP BY pa, pb")
def pair_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("a") - F.col("b")
    return stats.pair_rows(wide(spark, sf_dir), PRODUCTS).groupBy("pa", "pb").agg(F.count("*").alias("n"), r6(F.avg(d)).alias("bias"), r6(F.avg(F.abs(d))).alias("mae"), r6(F.sqrt(F.avg(d * d))).alias("rmse"))


@query(f"SELECT unit_id, round(CASE WHEN len(v) >= 2 THEN list_median(v) END, 6) AS med, CASE WHEN len(v) < 2 THEN NULL WHEN list_median(v) > 3500 THEN 'urban_center' ELSE 'peri_urban' END AS cls FROM (SELECT unit_id, list_filter([{', '.join(PRODUCTS)}], lambda x: x IS NOT NULL) AS v FROM {_WIDE})".replace("list_median(v)", "list_aggregate(v, 'median')"))
def population_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    med = fx.row_median([F.col(p) for p in PRODUCTS], least=2)
    return wide(spark, sf_dir).select("unit_id", r6(med).alias("med"), F.when(med > 3500, "urban_center").when(med <= 3500, "peri_urban").alias("cls"))


_Q = "SELECT product, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM products GROUP BY product"


@query(f"SELECT product, q1, med, q3, min(v) AS low, max(v) AS high FROM products JOIN ({_Q}) USING (product) WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY product, q1, med, q3")
def population_boxstats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.box_stats(layer(spark, sf_dir, "products"), ["product"], "v")


@query("SELECT src, year, count(*) AS n, count(h1) AS n_h1 FROM footprints GROUP BY src, year")
def crosstab_nulls_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "footprints").groupBy("src", "year").agg(F.count("*").alias("n"), F.count("h1").alias("n_h1"))


@query("SELECT zone, unit_id, round(100 * population / sum(population) OVER (PARTITION BY zone), 6) AS share FROM units")
def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("population").over(Window.partitionBy("zone"))
    return layer(spark, sf_dir, "units").select("zone", "unit_id", r6(100 * F.col("population") / total).alias("share"))


@query("SELECT src, round(sum(h1 * area) / sum(area), 6) AS wmean, round(stddev_samp(h1) / avg(h1), 6) AS cv FROM footprints WHERE h1 IS NOT NULL GROUP BY src")
def weighted_mean_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layer(spark, sf_dir, "footprints").where("h1 is not null")
    return f.groupBy("src").agg(r6(F.try_divide(F.sum(F.col("h1") * F.col("area")), F.sum("area"))).alias("wmean"), r6(F.try_divide(F.stddev_samp("h1"), F.avg("h1"))).alias("cv"))


@query("SELECT zone, string_agg(CAST(unit_id AS VARCHAR), ';' ORDER BY unit_id) AS ids, CAST(count(DISTINCT floor(population / 100)) AS BIGINT) AS kinds FROM units GROUP BY zone")
def collect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("unit_id")), lambda x: x.cast("string")), ";")
    return layer(spark, sf_dir, "units").groupBy("zone").agg(ids.alias("ids"), F.countDistinct(F.floor(F.col("population") / 100)).alias("kinds"))


# Windows and order ---------------------------------------------------------------------------


@query("SELECT src, id, area, CAST(k AS INT) AS k FROM (SELECT src, id, area, row_number() OVER (PARTITION BY src ORDER BY area DESC, id) AS k FROM footprints) WHERE k <= 20")
def rank_first_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("area"), "id"))
    return layer(spark, sf_dir, "footprints").select("src", "id", "area", k.alias("k")).where("k <= 20")


@query("SELECT id, sum(new) OVER (PARTITION BY src ORDER BY id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT id, src, CASE WHEN brand IS DISTINCT FROM lag(brand) OVER (PARTITION BY src ORDER BY id) THEN 1 ELSE 0 END AS new FROM footprints)")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("src").orderBy("id")
    new = F.when(F.col("brand").eqNullSafe(F.lag("brand").over(w)), 0).otherwise(1)
    return layer(spark, sf_dir, "footprints").withColumn("new", new).select("id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))


@query("SELECT id, sum(area) OVER (PARTITION BY src ORDER BY id ROWS UNBOUNDED PRECEDING) AS along FROM footprints")
def cumulative_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("src").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return layer(spark, sf_dir, "footprints").select("id", F.sum("area").over(w).alias("along"))


@query("SELECT id, CAST(1 + CAST(area > q[1] AS INT) + CAST(area > q[2] AS INT) + CAST(area > q[3] AS INT) AS INT) AS cls FROM footprints JOIN (SELECT src, quantile_cont(area, [0.25, 0.5, 0.75]) AS q FROM footprints GROUP BY src) USING (src)")
def quantile_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layer(spark, sf_dir, "footprints")
    q = f.groupBy("src").agg(F.percentile("area", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return f.join(q, "src").select("id", (1 + F.size(F.filter("q", lambda e: F.col("area") > e))).alias("cls"))


# Joins ---------------------------------------------------------------------------------------

_MEET = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"
_AREA = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layer(spark, sf_dir, "footprints")
    pairs = spatial.rect_pairs(f, f).where("a_id < b_id").withColumn("shared", fx.overlap_area("a_", "b_"))
    return pairs.where("shared >= 0.01 AND shared >= 0.2 * least(a_area, b_area)")


@query(f"SELECT a.id AS a_id, b.id AS b_id, {_AREA} AS shared FROM footprints a JOIN footprints b ON a.id < b.id AND {_MEET} WHERE {_AREA} >= 0.2 * least(a.area, b.area)")
def footprint_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts(spark, sf_dir).select("a_id", "b_id", "shared")


@query("SELECT p.id, min(u.unit_id) AS unit_id FROM points p LEFT JOIN units u ON p.x >= u.x0 AND p.x < u.x1 AND p.y >= u.y0 AND p.y < u.y1 GROUP BY p.id")
def point_to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = layer(spark, sf_dir, "points")
    hit = spatial.first_by(spatial.points_in(p, layer(spark, sf_dir, "units")), "id", "b_unit_id").select("id", F.col("b_unit_id").alias("unit_id"))
    return p.select("id").join(hit, "id", "left")


@query("SELECT id, f_id FROM (SELECT p.id, f.id AS f_id, row_number() OVER (PARTITION BY p.id ORDER BY f.area, f.id) AS k FROM points p JOIN footprints f ON p.x >= f.x0 AND p.x < f.x1 AND p.y >= f.y0 AND p.y < f.y1) WHERE k = 1")
def smallest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spatial.points_in(layer(spark, sf_dir, "points"), layer(spark, sf_dir, "footprints"))
    return spatial.first_by(hits, "id", "b_area", "b_id").select("id", F.col("b_id").alias("f_id"))


@query("SELECT a.id, count(*) AS n, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS mean_dist, round(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS least_dist FROM points a JOIN points b ON a.id <> b.id AND abs(a.x - b.x) <= 15 AND abs(a.y - b.y) <= 15 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 225 GROUP BY a.id")
def neighbours_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.points_within(layer(spark, sf_dir, "points"), 15.0).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"), r6(F.avg("dist")).alias("mean_dist"), r6(F.min("dist")).alias("least_dist"))


@query("""SELECT coalesce(a.id, b.id, c.id) AS id, n1, n2, n3 FROM (SELECT unit_id AS id, v AS n1 FROM products WHERE product = 'AF' AND unit_id % 3 <> 0) a FULL JOIN (SELECT unit_id AS id, v AS n2 FROM products WHERE product = 'NF' AND unit_id % 2 = 0) b ON a.id = b.id
FULL JOIN (SELECT unit_id AS id, v AS n3 FROM products WHERE product = 'RF' AND unit_id % 5 > 1) c ON coalesce(a.id, b.id) = c.id""")
def outer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer joins of tables that each lack some keys."""
    p = layer(spark, sf_dir, "products")
    part = lambda product, has, name: p.where((F.col("product") == product) & F.expr(has)).select(F.col("unit_id").alias("id"), F.col("v").alias(name))
    return joins.outer_chain([part("AF", "unit_id % 3 <> 0", "n1"), part("NF", "unit_id % 2 = 0", "n2"), part("RF", "unit_id % 5 > 1", "n3")], "id")


@query("SELECT brand, id FROM (SELECT brand, id, row_number() OVER (PARTITION BY brand ORDER BY (id % 2) DESC, (src = 1) DESC, area DESC, id) AS k FROM footprints) WHERE k = 1")
def select_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layer(spark, sf_dir, "footprints")
    return spatial.first_by(f, "brand", F.desc(F.col("id") % 2), F.desc(F.col("src") == 1), F.desc("area"), "id").select("brand", "id")


@query(f"SELECT b.unit_id, count(*) AS n, sum({_AREA}) AS built, round(100 * sum({_AREA}) / 2500, 6) AS pct FROM footprints a JOIN units b ON {_MEET} GROUP BY b.unit_id")
def unit_building_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.rect_pairs(layer(spark, sf_dir, "footprints"), layer(spark, sf_dir, "units")).withColumn("shared", fx.overlap_area("a_", "b_"))
    return pairs.groupBy(F.col("b_unit_id").alias("unit_id")).agg(F.count("*").alias("n"), F.sum("shared").alias("built"), r6(100 * F.sum("shared") / 2500).alias("pct"))


@query(f"SELECT a.id, b.unit_id, round(b.population * {_AREA} / t.total, 6) AS population FROM footprints a JOIN units b ON {_MEET} JOIN (SELECT b.unit_id, sum({_AREA}) AS total FROM footprints a JOIN units b ON {_MEET} GROUP BY b.unit_id) t ON t.unit_id = b.unit_id")
def population_apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spatial.rect_pairs(layer(spark, sf_dir, "footprints"), layer(spark, sf_dir, "units")).withColumn("shared", fx.overlap_area("a_", "b_"))
    total = F.sum("shared").over(Window.partitionBy("b_unit_id"))
    return pairs.select(F.col("a_id").alias("id"), F.col("b_unit_id").alias("unit_id"), r6(F.col("b_population") * F.col("shared") / total).alias("population"))


@query(f"SELECT a.id, max({_AREA} / (a.area + b.area - {_AREA})) > 0.1 AS dropped, round(max({_AREA} / (a.area + b.area - {_AREA})), 6) AS iou FROM footprints a JOIN footprints b ON a.src <> b.src AND {_MEET} GROUP BY a.id")
def iou_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layer(spark, sf_dir, "footprints")
    s = fx.overlap_area("a_", "b_")
    pairs = spatial.rect_pairs(f, f).where("a_src <> b_src").withColumn("iou", s / (F.col("a_area") + F.col("b_area") - s))
    return pairs.groupBy(F.col("a_id").alias("id")).agg((F.max("iou") > 0.1).alias("dropped"), r6(F.max("iou")).alias("iou"))


@query(f"SELECT a.id, max(CASE WHEN {_AREA} >= 1 AND {_AREA} >= 0.35 * least(a.area, b.area) THEN 1 ELSE 0 END) = 1 AS supported FROM footprints a JOIN footprints b ON a.src = 0 AND b.src = 1 AND {_MEET} GROUP BY a.id")
def footprint_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = layer(spark, sf_dir, "footprints")
    s = fx.overlap_area("a_", "b_")
    pairs = spatial.rect_pairs(f.where("src = 0"), f.where("src = 1"))
    return pairs.groupBy(F.col("a_id").alias("id")).agg(F.bool_or((s >= 1) & (s >= 0.35 * F.least("a_area", "b_area"))).alias("supported"))


_COURTS = "SELECT id, x0, y0, x1, y1, area FROM footprints UNION ALL SELECT id + 1000000, x0 + 1, y0 + 1, x1 - 1, y1 - 1, (x1 - x0 - 2) * (y1 - y0 - 2) FROM footprints WHERE id % 10 = 0"


@query(f"WITH f AS ({_COURTS}) SELECT DISTINCT b.id FROM f a JOIN f b ON a.id <> b.id AND a.x0 >= b.x0 AND a.x1 <= b.x1 AND a.y0 >= b.y0 AND a.y1 <= b.y1 AND b.area > a.area")
def nested_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of footprints and courts inside some of them, those that contain another."""
    f = spark.sql(_COURTS.replace("FROM footprints", "FROM {f}"), f=layer(spark, sf_dir, "footprints"))
    return spatial.rect_pairs(f, f).where("a_id <> b_id AND a_x0 >= b_x0 AND a_x1 <= b_x1 AND a_y0 >= b_y0 AND a_y1 <= b_y1 AND b_area > a_area").select(F.col("b_id").alias("id")).distinct()


@query("SELECT zone, CAST(sum(CASE WHEN n THEN 1 ELSE 0 END) AS BIGINT) AS ones, CASE WHEN sum(CASE WHEN n THEN 1 ELSE 0 END) * 2 > count(*) THEN 1 WHEN sum(CASE WHEN n THEN 1 ELSE 0 END) * 2 < count(*) THEN 0 END AS major, sum(CASE WHEN n THEN 1 ELSE 0 END) * 2 = count(*) AS tie FROM (SELECT zone, population > 750 AS n FROM units) GROUP BY zone")
def majority_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    ones = F.count_if(F.col("population") > 750)
    return layer(spark, sf_dir, "units").groupBy("zone").agg(ones.alias("ones"), F.when(ones * 2 > F.count("*"), 1).when(ones * 2 < F.count("*"), 0).alias("major"), (ones * 2 == F.count("*")).alias("tie"))


@query("SELECT a.unit_id AS src, b.unit_id AS dst, CAST(50 AS DOUBLE) AS len FROM units a JOIN units b ON a.unit_id < b.unit_id AND ((a.x1 = b.x0 AND a.y0 = b.y0) OR (a.y1 = b.y0 AND a.x0 = b.x0))")
def rook_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = layer(spark, sf_dir, "units")
    side = lambda xa, ya, xb, yb: F.struct(F.col(xa).alias("xa"), F.col(ya).alias("ya"), F.col(xb).alias("xb"), F.col(yb).alias("yb"))
    sides = u.select("unit_id", F.inline(F.array(side("x0", "y0", "x1", "y0"), side("x0", "y1", "x1", "y1"), side("x0", "y0", "x0", "y1"), side("x1", "y0", "x1", "y1"))))
    both = sides.groupBy("xa", "ya", "xb", "yb").agg(F.min("unit_id").alias("src"), F.max("unit_id").alias("dst")).where("src < dst")
    return both.select("src", "dst", (F.col("xb") - F.col("xa") + F.col("yb") - F.col("ya")).alias("len"))


# Rasters -------------------------------------------------------------------------------------


@query("SELECT r, c, CAST(max(CASE WHEN band = 'A' AND v > 30 THEN 1 ELSE 0 END) + max(CASE WHEN band = 'N' AND v > 30 THEN 2 ELSE 0 END) + max(CASE WHEN band = 'R' AND v > 30 THEN 4 ELSE 0 END) AS INT) AS code FROM cells GROUP BY r, c")
def presence_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.presence_codes(layer(spark, sf_dir, "cells"), ["A", "N", "R"], 30)


@query("SELECT band, CAST(floor(r / 4) AS BIGINT) AS r, CAST(floor(c / 4) AS BIGINT) AS c, round(avg(v), 6) AS v, max(v) AS top FROM cells GROUP BY 1, 2, 3")
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_mean(layer(spark, sf_dir, "cells"), 4).withColumn("v", r6("v"))


@query("SELECT a.band, a.r, a.c, sum(b.v) AS total, count(b.v) AS n FROM cells a JOIN cells b ON a.band = b.band AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY a.band, a.r, a.c")
def focal_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.focal_sum(layer(spark, sf_dir, "cells"), 2)


@query("SELECT r, c, v, band FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY CASE band WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS k FROM cells) WHERE k = 1")
def mosaic_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mosaic_first(layer(spark, sf_dir, "cells"), ["R", "A", "N"])


@query("SELECT r, c, count(*) AS valid, CAST(sum(CASE WHEN v > 30 THEN 1 ELSE 0 END) AS BIGINT) AS water, round(sum(CASE WHEN v > 30 THEN 1 ELSE 0 END) / count(*), 6) AS occurrence, bool_and(v > 30) AS permanent FROM cells GROUP BY r, c")
def water_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    wet = F.count_if(F.col("v") > 30)
    return layer(spark, sf_dir, "cells").groupBy("r", "c").agg(F.count("*").alias("valid"), wet.alias("water"), r6(wet / F.count("*")).alias("occurrence"), F.bool_and(F.col("v") > 30).alias("permanent"))


@query("SELECT p.id, round(avg(k.v), 6) AS v FROM points p JOIN cells k ON k.r = CAST(floor(p.y / 16) AS BIGINT) AND k.c = CAST(floor(p.x / 16) AS BIGINT) GROUP BY p.id")
def point_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = layer(spark, sf_dir, "points").select("id", F.floor(F.col("y") / 16).alias("r"), F.floor(F.col("x") / 16).alias("c"))
    return p.join(layer(spark, sf_dir, "cells"), ["r", "c"]).groupBy("id").agg(r6(F.avg("v")).alias("v"))


@query("SELECT CAST(r % 8 AS BIGINT) AS unit, CAST(sum(CASE WHEN v <= 25 THEN 1 ELSE 0 END) AS BIGINT) AS early, CAST(sum(CASE WHEN v > 25 AND v <= 75 THEN 1 ELSE 0 END) AS BIGINT) AS middle, CAST(sum(CASE WHEN v > 75 THEN 1 ELSE 0 END) AS BIGINT) AS late FROM cells GROUP BY 1")
def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return layer(spark, sf_dir, "cells").groupBy((F.col("r") % 8).alias("unit")).agg(F.count_if(v <= 25).alias("early"), F.count_if((v > 25) & (v <= 75)).alias("middle"), F.count_if(v > 75).alias("late"))


# Greedy --------------------------------------------------------------------------------------


@query(None)
def footprint_recency_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first (unknown dates last, then source, then id); the greedy order has no SQL."""
    f = layer(spark, sf_dir, "footprints")
    known = F.coalesce(F.col("year"), F.lit(0)).cast("long")
    nodes = f.select("id", F.struct((-known).alias("y"), "src", "id").alias("pos"))
    e = conflicts(spark, sf_dir).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return graph.recency_suppress(nodes, e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-available footprints: suppress conflicts, pick heights, sum by source."""
    kept = footprint_recency_kept(spark, sf_dir).where("kept").select("id")
    f = layer(spark, sf_dir, "footprints").join(kept, "id").join(height_priority(spark, sf_dir), "id")
    return f.groupBy("src").agg(F.count("*").alias("kept"), F.sum("area").alias("area"), r6(F.median("height")).alias("median_height"))


from cityloom.plans import places, rasters, regions, rules, segments, shapes, tables  # noqa: E402, F401  (register their queries)
