"""Queries of coercions, keys, filters, flags and row-wise estimates.

Columns that the tables lack are made by one SQL expression that both engines read;
the rule itself is written twice, in columns and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.functions import columns as fx
from cityloom.functions import rules
from cityloom.plans.register import query, r6
from cityloom.sources.layers import layer


def made(spark: SparkSession, sf_dir: str, name: str, **columns: str) -> DataFrame:
    return layer(spark, sf_dir, name).withColumns({k: F.expr(v) for k, v in columns.items()})


def _with(name: str, columns: dict[str, str]) -> str:
    return "(SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {name})"


_RAW = {"raw": "CASE id % 4 WHEN 0 THEN '12.5' WHEN 1 THEN 'n/a' WHEN 2 THEN '' ELSE CAST(id AS STRING) END"}


@query(f"SELECT id, TRY_CAST(raw AS DOUBLE) AS value FROM {_with('ways', _RAW)}")
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "ways", **_RAW).select("id", rules.to_float(F.col("raw")).alias("value"))


_TYPED = {"f": "CASE id % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '0' WHEN 3 THEN NULL ELSE 't' END", "y": "CASE id % 4 WHEN 0 THEN '2021.7' WHEN 1 THEN 'abc' WHEN 2 THEN NULL ELSE CAST(1990 + id % 30 AS STRING) END"}


@query(f"SELECT id, coalesce(lower(trim(f)) IN ('true', 't', '1', 'yes', 'y'), FALSE) AS flag, CAST(trunc(TRY_CAST(y AS DOUBLE)) AS INT) AS year FROM {_with('ways', _TYPED)}")
def typed_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "ways", **_TYPED).select("id", rules.to_bool(F.col("f")).alias("flag"), rules.get_year(F.col("y")).alias("year"))


_KEYS = {"raw": "CASE id % 6 WHEN 0 THEN '7' WHEN 1 THEN concat(CAST(id AS STRING), '.0') WHEN 2 THEN ' 7 ' WHEN 3 THEN ' A-7 ' WHEN 4 THEN '7.5' ELSE NULL END"}


@query(f"SELECT id, CASE WHEN TRY_CAST(raw AS DOUBLE) = floor(TRY_CAST(raw AS DOUBLE)) THEN CAST(CAST(TRY_CAST(raw AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE nullif(trim(raw), '') END AS k FROM {_with('ways', _KEYS)}")
def normalize_join_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "ways", **_KEYS).select("id", rules.normalize_join_key(F.col("raw")).alias("k"))


_NAMES = {"raw": "CASE id % 3 WHEN 0 THEN name WHEN 1 THEN concat('_', CAST(id AS STRING)) ELSE class END"}


@query(f"SELECT id, TRY_CAST(regexp_extract(raw, '_([0-9]+)', 1) AS BIGINT) AS number FROM {_with('blocks', _NAMES)}")
def parse_block_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "blocks", **_NAMES).select("id", rules.block_number(F.col("raw")).alias("number"))


@query("SELECT id, concat_ws('_', 'blk', zone, id, label) AS block_id, concat('z', zone, '_s', lpad(CAST(id % 10000 AS VARCHAR), 4, '0')) AS segment_id, lpad(CAST(id AS VARCHAR), 8, '0') AS file_id FROM blocks")
def compose_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    return layer(spark, sf_dir, "blocks").select("id", F.concat_ws("_", F.lit("blk"), s("zone"), s("id"), s("label")).alias("block_id"), F.concat(F.lit("z"), s("zone"), F.lit("_s"), F.lpad((F.col("id") % 10000).cast("string"), 4, "0")).alias("segment_id"), F.lpad(s("id"), 8, "0").alias("file_id"))


@query("SELECT id, concat(replace(class, '_', '-'), '_', replace(name, '_', '-'), '_', coalesce(CAST(step AS VARCHAR), 'NULL')) AS k FROM blocks")
def concat_zone_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "blocks").select("id", rules.zone_key([F.col("class"), F.col("name"), F.col("step").cast("string")]).alias("k"))


@query("SELECT id, concat_ws('; ', highway, area, tag) AS text FROM ways")
def list_to_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists as one text; missing members are left out."""
    return layer(spark, sf_dir, "ways").select("id", F.array_join(F.array("highway", "area", "tag"), "; ").alias("text"))


_SOURCES = {"sources": """CASE WHEN id % 7 = 0 THEN NULL ELSE concat('[{"dataset":"', tag, '","update_time":"20', lpad(CAST(id % 25 AS STRING), 2, '0'), '-01-01"},{"dataset":"x","update_time":"20', lpad(CAST(id % 23 AS STRING), 2, '0'), '-06-01"}]') END"""}


@query(f"SELECT id, sources::JSON->0->>'dataset' AS dataset, greatest(sources::JSON->0->>'update_time', sources::JSON->1->>'update_time') AS latest FROM {_with('ways', _SOURCES)}")
def source_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset of the first source and the latest update of all."""
    got = F.from_json("sources", "array<struct<dataset:string,update_time:string>>")
    rows = made(spark, sf_dir, "ways", **_SOURCES).select("id", got.alias("s"))
    return rows.select("id", F.get("s", F.lit(0))["dataset"].alias("dataset"), F.array_max(F.transform("s", lambda x: x["update_time"])).alias("latest"))


_MIXED = {"hw": "CASE id % 5 WHEN 0 THEN concat(highway, '; primary_link') WHEN 1 THEN concat(highway, '; trunk') ELSE highway END"}
_NOT_LINK = "hw NOT LIKE '%motorway_link%' AND hw NOT LIKE '%trunk_link%' AND hw NOT LIKE '%primary_link%'"
_ANY_MAIN = "(hw LIKE '%motorway%' OR hw LIKE '%trunk%' OR hw LIKE '%primary%')"


@query(f"SELECT id, hw FROM {_with('ways', _MIXED)} WHERE ({_ANY_MAIN} AND {_NOT_LINK}) OR " + " OR ".join(f"(hw LIKE '%{x}%' AND {_ANY_MAIN} AND hw <> '{x}')" for x in rules.LINKS))
def road_class_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "ways", **_MIXED).where(rules.keeps_main_roads(F.col("hw"))).select("id", "hw")


_WATER = {"geom": "CASE id % 3 WHEN 0 THEN 'LineString' WHEN 1 THEN 'Polygon' ELSE 'Point' END", "waterway": "CASE id % 4 WHEN 0 THEN 'river' WHEN 1 THEN 'ditch' END", "natur": "CASE id % 5 WHEN 0 THEN 'water' WHEN 1 THEN 'wetland' WHEN 2 THEN 'wood' END", "water": "CASE id % 7 WHEN 0 THEN 'lake' WHEN 1 THEN 'pool' END"}


@query(f"""SELECT id, CASE WHEN geom = 'LineString' THEN 'line' ELSE 'polygon' END AS kind FROM {_with('ways', _WATER)} WHERE (geom = 'LineString' AND waterway IN ('river', 'stream'))
OR (geom = 'Polygon' AND ((natur = 'water' AND (water IS NULL OR water IN ('lake', 'river'))) OR natur = 'wetland' OR waterway IN ('river', 'stream')))""")
def osm_water_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rules.osm_water(F.col("geom"), F.col("waterway"), F.col("natur"), F.col("water"), ("river", "stream"), ("lake", "river"))
    return made(spark, sf_dir, "ways", **_WATER).select("id", kind.alias("kind")).where("kind is not null")


@query("SELECT id, highway, len FROM ways WHERE highway IN ('motorway', 'trunk', 'primary', 'residential', 'service', 'living_street') AND area IS DISTINCT FROM 'yes'")
def vehicle_road_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = ("motorway", "trunk", "primary", "residential", "service", "living_street")
    return layer(spark, sf_dir, "ways").where(rules.vehicle_road(F.col("highway"), F.col("area"), allowed)).select("id", "highway", "len")


_SCORED = {"outlier": "CASE id % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'no' WHEN 2 THEN NULL ELSE '1' END", "cls": "CASE id % 3 WHEN 0 THEN 'built' WHEN 1 THEN 'trees' END", "prob": "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 100 AS DOUBLE) / 100 END",
           "g25": "CASE WHEN id % 6 = 0 THEN NULL ELSE CAST(id % 29 AS DOUBLE) / 100 END", "conf": "CASE id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN NULL ELSE 'medium' END", "provider": "CASE id % 4 WHEN 0 THEN '3D-GloBFP' WHEN 1 THEN 'OSM' WHEN 2 THEN NULL ELSE 'Overture' END"}


@query(f"""SELECT id, CASE WHEN coalesce(provider, '') <> '3D-GloBFP' AND coalesce(year >= 2023, FALSE) THEN FALSE WHEN coalesce(cls = 'built' AND prob >= 0.6, FALSE) THEN FALSE
ELSE (coalesce(outlier IN ('True', '1'), FALSE) AND (cls IS DISTINCT FROM 'built' OR prob IS NULL OR prob < 0.6) AND conf IS DISTINCT FROM 'high') OR coalesce(g25 <= 0.1 AND year < 2024, FALSE) END AS dropped FROM {_with('footprints', _SCORED)}""")
def fp_rules_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return made(spark, sf_dir, "footprints", **_SCORED).select("id", rules.false_positive_a(c("year"), c("outlier"), c("cls"), c("prob"), c("g25"), c("conf"), c("provider")).alias("dropped"))


@query(f"""SELECT id FROM (SELECT * FROM {_with('footprints', _SCORED)} WHERE NOT ((coalesce(outlier IN ('True', '1'), FALSE) AND conf IS DISTINCT FROM 'high' AND cls IS DISTINCT FROM 'built') OR coalesce(cls = 'built' AND prob < 0.6, FALSE)))
WHERE NOT (coalesce(g25 < 0.1, FALSE) AND (provider IS DISTINCT FROM 'OSM' OR coalesce(year > 2023, FALSE)))""")
def fp_rules_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = made(spark, sf_dir, "footprints", **_SCORED)
    first = rows.where(~rules.false_positive_b1(rules.to_bool(c("outlier")), c("cls"), c("prob"), c("conf")))
    return first.where(~rules.false_positive_b2(c("g25"), c("provider"), c("year"))).select("id")


_EXTREMES = {"hh": "id % 4 = 0", "cc": "id % 6 < 2"}
_FLAGS = f"SELECT id, area, people, CAST(hh AND cc AS INT) AS hh_cc, CAST(hh AND NOT cc AND area > 100000 AS INT) AS hh_big, CAST(cc AND NOT hh AND area > 100000 AS INT) AS cc_big, CAST(people > 1000 AS INT) AS large_pop FROM {_with('blocks', _EXTREMES)}"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, "blocks", **_EXTREMES)
    return rows.withColumns(rules.screening(F.col("hh"), F.col("cc"), F.col("area"), F.col("people")))


@query(f"SELECT id, hh_cc, hh_big, cc_big, large_pop FROM ({_FLAGS})")
def screening_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("id", "hh_cc", "hh_big", "cc_big", "large_pop")


@query(f"SELECT id FROM ({_FLAGS}) WHERE hh_cc = 1 OR hh_big = 1 OR cc_big = 1 OR large_pop = 1")
def select_any_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).where(F.greatest("hh_cc", "hh_big", "cc_big", "large_pop") == 1).select("id")


@query(f"SELECT id, CAST(CASE WHEN hh_cc = 1 THEN 1 WHEN hh_big = 1 THEN 2 WHEN cc_big = 1 THEN 3 ELSE 0 END AS INT) AS code FROM ({_FLAGS})")
def heterogeneity_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("id", rules.heterogeneity(F.col("hh_cc"), F.col("hh_big"), F.col("cc_big")).alias("code"))


@query("SELECT id, CAST(class = 'MACHINERY' AS INT) AS airport, CAST(class = 'FURNITURE' AS INT) AS open_space, area, round(4 * sqrt(area), 6) AS perimeter FROM blocks")
def class_to_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = lambda v: F.coalesce((F.col("class") == v).cast("int"), F.lit(0))
    return layer(spark, sf_dir, "blocks").select("id", flag("MACHINERY").alias("airport"), flag("FURNITURE").alias("open_space"), "area", r6(4 * F.sqrt("area")).alias("perimeter"))


@query("SELECT id, CASE WHEN people IS NULL THEN NULL ELSE concat(CASE WHEN people >= 500 THEN 'large' ELSE 'small' END, '_', CASE WHEN zone % 2 = 0 THEN 'city_segment' ELSE 'hexgrid' END) END AS grp FROM blocks")
def reporting_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("people") >= 500, "large").when(F.col("people") < 500, "small")
    return layer(spark, sf_dir, "blocks").select("id", F.concat(size, F.lit("_"), F.when(F.col("zone") % 2 == 0, "city_segment").otherwise("hexgrid")).alias("grp"))


@query("SELECT id, " + ", ".join(f"CASE WHEN people < {t} THEN 'peri_urban' WHEN people >= {t} THEN 'urban_center' END AS at_{t}" for t in (1000, 1500, 2000)) + " FROM (SELECT id, people * 2 AS people FROM blocks)")
def classify_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary threshold of 1,500 and the sensitivity of the classes to it."""
    p = F.col("people") * 2
    return layer(spark, sf_dir, "blocks").select("id", *(F.when(p < t, "peri_urban").when(p >= t, "urban_center").alias(f"at_{t}") for t in (1000, 1500, 2000)))


@query("""SELECT id, CASE WHEN src <> 0 AND height IS NOT NULL THEN 'medium' WHEN src <> 0 AND support THEN 'medium' WHEN src = 0 AND (support OR version >= 2) THEN 'high' WHEN src = 0 THEN 'medium' ELSE 'low' END AS confidence,
CASE WHEN src <> 0 AND height IS NULL AND NOT support THEN TRUE ELSE n >= 2 AND spread > 5 END AS review
FROM (SELECT id, src, id % 4 = 0 AS support, id % 3 AS version, h1 AS height, CAST(h1 IS NOT NULL AS INT) + CAST(h2 IS NOT NULL AS INT) AS n, coalesce(abs(h1 - h2), 0) AS spread FROM footprints)""")
def confidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence by source, support, version and height; low ones and wide ranges are reviewed."""
    f = made(spark, sf_dir, "footprints", support="id % 4 = 0", version="id % 3")
    level = rules.confidence(F.col("src") == 0, F.col("support"), F.col("version"), F.col("h1"))
    wide = F.col("h1").isNotNull() & F.col("h2").isNotNull() & (F.coalesce(F.abs(F.col("h1") - F.col("h2")), F.lit(0.0)) > 5)
    return f.select("id", level.alias("confidence"), ((level == "low") | wide).alias("review"))


@query("SELECT id, CASE WHEN balance > 0 THEN round(ln(balance), 6) END AS log FROM blocks")
def safe_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, "blocks").select("id", r6(rules.safe_log(F.col("balance"))).alias("log"))


@query("SELECT id, round(d80 / nullif(d5, 0), 6) AS r80_5, round(d40 / nullif(d5, 0), 6) AS r40_5 FROM (SELECT id, area AS d80, CAST(people AS DOUBLE) AS d40, CAST(step AS DOUBLE) AS d5 FROM blocks)")
def spacing_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    d5 = F.col("step").cast("double")
    return layer(spark, sf_dir, "blocks").select("id", r6(F.try_divide(F.col("area"), d5)).alias("r80_5"), r6(F.try_divide(F.col("people").cast("double"), d5)).alias("r40_5"))


_HISTORY = {"built": "CAST(people AS DOUBLE)", "w23": "CAST(id % 5 * 10 AS DOUBLE)", "w26": "CAST(id % 7 * 12 AS DOUBLE)"}


@query(f"SELECT id, CASE WHEN w23 > 0 THEN round(built / w23, 6) END AS ratio, CASE WHEN w23 > 0 AND w26 > 0 THEN round(w26 * built / w23, 6) END AS estimate FROM {_with('blocks', _HISTORY)}")
def wsf_ratio_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.when(F.col("w23") > 0, F.col("built") / F.col("w23"))
    return made(spark, sf_dir, "blocks", **_HISTORY).select("id", r6(ratio).alias("ratio"), r6(F.when(F.col("w26") > 0, F.col("w26") * F.col("built") / F.when(F.col("w23") > 0, F.col("w23")))).alias("estimate"))


@query(f"SELECT id, round(step * (built / nullif(w23, 0)), 6) AS one_year, round(3 * step * (built / nullif(w23, 0)), 6) AS three_years FROM {_with('blocks', _HISTORY)}")
def new_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = F.try_divide("built", "w23")
    return made(spark, sf_dir, "blocks", **_HISTORY).select("id", r6(F.col("step") * ratio).alias("one_year"), r6(3 * F.col("step") * ratio).alias("three_years"))


_TIDY = {"n": "id % 3", "total": "area", "low": "area / 4", "sd": "area / 9"}


@query(f"SELECT id, CASE n WHEN 0 THEN NULL WHEN 1 THEN round(total, 6) ELSE round(low, 6) END AS least, CASE n WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE round(sd, 6) END AS stdev FROM {_with('blocks', _TIDY)}")
def tidy_single_building(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = lambda c, one: F.when(F.col("n") == 0, None).when(F.col("n") == 1, one).otherwise(F.col(c))
    return made(spark, sf_dir, "blocks", **_TIDY).select("id", r6(tidy("low", F.col("total"))).alias("least"), r6(tidy("sd", F.lit(0.0))).alias("stdev"))


_FILES = {"file": "CASE WHEN id % 4 = 0 THEN concat('img_', lpad(CAST(id AS STRING), 15, '1'), '_rgb.tif') ELSE concat('img_', CAST(id AS STRING), '_rgb.tif') END"}


@query(f"SELECT id, nullif(regexp_extract(file, '_([0-9]{{15}})_', 1), '') AS image FROM {_with('blocks', _FILES)}")
def image_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, "blocks", **_FILES).select("id", F.nullif(F.regexp_extract("file", r"_(\d{15})_", 1), F.lit("")).alias("image"))


@query("SELECT zone, format('{:,} ({:.1f}%)', n, 100.0 * n / total) AS text FROM (SELECT zone, count(*) AS n FROM ways JOIN blocks ON blocks.id = ways.unit_id GROUP BY zone), (SELECT count(*) AS total FROM ways)")
def fmt_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with thousands separators and percentages."""
    ways = layer(spark, sf_dir, "ways")
    n = ways.join(layer(spark, sf_dir, "blocks").select(F.col("id").alias("unit_id"), "zone"), "unit_id").groupBy("zone").agg(F.count("*").alias("n"))
    total = F.broadcast(ways.agg(F.count("*").alias("total")))  # one row
    return n.crossJoin(total).select("zone", rules.n_pct(F.col("n"), F.col("total")).alias("text"))


@query("SELECT unit_id, round(n / (2500 / 10000.0), 6) AS count_ha, round(built / 2500, 6) AS area_share, round(abs(n - 1) / greatest(abs(n), 1, 1), 6) AS diff FROM (SELECT u.unit_id, count(f.id) AS n, coalesce(sum(f.area), 0) AS built FROM units u LEFT JOIN footprints f ON f.id = u.unit_id AND f.src = 1 GROUP BY u.unit_id)")
def unit_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings a hectare, share of the area that is built, and the relative difference from one building."""
    f = layer(spark, sf_dir, "footprints").where("src = 1").select(F.col("id").alias("unit_id"), F.col("area").alias("f_area"))
    per = layer(spark, sf_dir, "units").join(f, "unit_id", "left").groupBy("unit_id").agg(F.count("f_area").alias("n"), F.coalesce(F.sum("f_area"), F.lit(0.0)).alias("built"))
    return per.select("unit_id", r6(F.col("n") / 0.25).alias("count_ha"), r6(F.col("built") / 2500).alias("area_share"), r6(fx.rel_diff(F.col("n"), F.lit(1))).alias("diff"))


@query("""SELECT id, CASE WHEN h1 BETWEEN 0.5 AND 100 THEN h1 WHEN fl > 0 AND fl <= 40 THEN 3.0 * fl WHEN h2 BETWEEN 0.5 AND 100 THEN h2 WHEN h3 BETWEEN 0.5 AND 100 THEN h3 END AS height,
CASE WHEN h1 BETWEEN 0.5 AND 100 THEN 'high' WHEN (fl > 0 AND fl <= 40) OR h2 BETWEEN 0.5 AND 100 THEN 'medium' WHEN h3 BETWEEN 0.5 AND 100 THEN 'low' END AS confidence FROM (SELECT *, CAST(CASE WHEN id % 3 = 0 THEN id % 50 END AS DOUBLE) AS fl FROM footprints)""")
def height_with_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own height, floors of 3 m, a model's height, a raster's; with how sure each is."""
    f = made(spark, sf_dir, "footprints", fl="CAST(CASE WHEN id % 3 = 0 THEN id % 50 END AS DOUBLE)")
    ok = [F.col("h1").between(0.5, 100), (F.col("fl") > 0) & (F.col("fl") <= 40), F.col("h2").between(0.5, 100), F.col("h3").between(0.5, 100)]
    values = (F.col("h1"), 3.0 * F.col("fl"), F.col("h2"), F.col("h3"))
    pick = lambda what: F.coalesce(*(F.when(o, w) for o, w in zip(ok, what, strict=True)))
    return f.select("id", pick(values).alias("height"), pick([F.lit(x) for x in ("high", "medium", "medium", "low")]).alias("confidence"))


@query("""SELECT id, CAST(CASE WHEN big THEN CASE WHEN p2 < 1000 THEN 2 WHEN p3 < 1000 THEN 3 WHEN p4 < 1000 THEN 4 ELSE 5 END WHEN hetero THEN CASE WHEN a2 < 100000 THEN 2 WHEN a3 < 100000 THEN 3 WHEN a4 < 100000 THEN 4 ELSE 5 END END AS INT) AS k
FROM (SELECT id, people > 500 AS big, id % 3 = 0 AS hetero, people * 3 / 2 AS p2, people * 3 / 3 AS p3, people * 3 / 4 AS p4, area / 2 AS a2, CASE WHEN id % 8 = 0 THEN NULL ELSE area / 3 END AS a3, area / 4 AS a4 FROM blocks)""")
def candidate_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of splits into 2..5 parts the first with less than 1,000 people a part (large
    populations) or 100,000 m2 a part (mixed ones), else 5; an unknown value fails."""
    b = layer(spark, sf_dir, "blocks")
    people, area = {k: F.col("people") * 3 / k for k in (2, 3, 4)}, {k: F.col("area") / k for k in (2, 3, 4)}
    area[3] = F.when(F.col("id") % 8 != 0, area[3])
    first = lambda parts, most: F.coalesce(*(F.when(parts[k] < most, k) for k in (2, 3, 4)), F.lit(5))
    return b.select("id", F.when(F.col("people") > 500, first(people, 1000)).when(F.col("id") % 3 == 0, first(area, 100_000)).alias("k"))
