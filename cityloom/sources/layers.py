"""Layers derived from the standard tables with integer arithmetic that any engine repeats.

Each constant is the SELECT that defines a layer; ``layer`` runs it on Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Units along a side of the extent, which grows with the tables.
_GRID = "(SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS s FROM part) AS g"
#: Building rectangles with source, area, dates (some unknown) and heights by three sources.
FOOTPRINTS = f"""SELECT p_partkey AS id, p_partkey % 3 AS src, CAST((p_partkey * 7919) % (50 * s) AS DOUBLE) AS x0, CAST((p_partkey * 104729) % (50 * s - 3) AS DOUBLE) AS y0,
CAST((p_partkey * 7919) % (50 * s) + 4 + p_size AS DOUBLE) AS x1, CAST((p_partkey * 104729) % (50 * s - 3) + 4 + p_partkey % 23 AS DOUBLE) AS y1,
CAST((4 + p_size) * (4 + p_partkey % 23) AS DOUBLE) AS area, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 2000 + p_partkey % 25 END AS year,
CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice / 20 END AS h1, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 4 END AS h2,
CASE WHEN p_partkey % 6 < 3 THEN NULL ELSE CAST(p_partkey % 130 AS DOUBLE) END AS h3, p_brand AS brand FROM part CROSS JOIN {_GRID}"""
#: Square units of 50 m over the extent, one for each part, with the people that all line items of it sum to.
UNITS = f"""SELECT p_partkey AS unit_id, CAST((p_partkey % s) * 50 AS DOUBLE) AS x0, CAST(floor(p_partkey / CAST(s AS DOUBLE)) * 50 AS DOUBLE) AS y0,
CAST((p_partkey % s) * 50 + 50 AS DOUBLE) AS x1, CAST(floor(p_partkey / CAST(s AS DOUBLE)) * 50 + 50 AS DOUBLE) AS y1, p_partkey % 7 AS zone,
coalesce(people, CAST(0 AS DOUBLE)) AS population FROM part CROSS JOIN {_GRID} LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS people FROM lineitem GROUP BY l_partkey) AS l ON l_partkey = p_partkey"""
#: Building points.
POINTS = f"""SELECT event_id AS id, CAST((event_id * 7919) % (50 * s + 9) AS DOUBLE) AS x, CAST((event_id * 104729) % (50 * s - 3) AS DOUBLE) AS y, event_type AS kind, value FROM events CROSS JOIN {_GRID}"""
#: Values of four products in each unit, from all line items; some are unknown.
PRODUCTS = """SELECT l_suppkey AS unit_id, concat(l_returnflag, l_linestatus) AS product, CASE WHEN (l_suppkey + ascii(l_returnflag) + ascii(l_linestatus)) % 7 = 0 THEN NULL ELSE CAST(sum(l_quantity) AS DOUBLE) END AS v FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus"""
#: Cells of 16 m of a raster over the extent, with three bands, from all line items.
CELLS = f"""SELECT l_returnflag AS band, l_partkey % CAST(ceil(50 * s / 16.0) AS BIGINT) AS r, l_orderkey % CAST(ceil(50 * s / 16.0) AS BIGINT) AS c, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem CROSS JOIN {_GRID} GROUP BY 1, 2, 3"""
_CLASSES = ("motorway", "motorway_link", "trunk", "primary", "secondary_link", "residential", "service", "footway", "cycleway", "track", "steps", "living_street")
_HIGHWAY = "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES)) + " END"
#: Ways with classes, tags and lengths, one for each order.
WAYS = f"""SELECT o_orderkey AS id, {_HIGHWAY} AS highway,
CASE WHEN o_orderkey % 31 = 0 THEN 'yes' END AS area, o_totalprice / 1000 AS len, o_custkey AS unit_id, o_orderpriority AS tag, o_orderstatus AS status FROM orders"""
#: Blocks: units with classes, areas, cluster labels, probabilities and steps of a settlement history.
BLOCKS = """SELECT c_custkey AS id, c_nationkey AS zone, c_mktsegment AS class, c_acctbal AS balance, abs(c_acctbal) * 25 AS area, CAST(floor(abs(c_acctbal) / 8) AS BIGINT) AS people, c_custkey % 3 AS label,
CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS DOUBLE) / 100 END AS prob, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 21 END AS step, concat('blk_', CAST(c_custkey AS STRING), '_', CAST(c_nationkey AS STRING)) AS name FROM customer"""

LAYERS = {"footprints": FOOTPRINTS, "units": UNITS, "points": POINTS, "products": PRODUCTS, "cells": CELLS, "ways": WAYS, "blocks": BLOCKS}


def tables_of(sql: str) -> set[str]:
    return {t for t in TABLES if re.search(rf"\b{t}\b", sql)}


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = LAYERS[name]
    own = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)}
    for t in own:
        sql = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **own)


def _for_duckdb(sql: str) -> str:
    return sql.replace("AS STRING", "AS VARCHAR")


def with_layers(sql: str) -> str:
    """SQL for DuckDB: the layers that ``sql`` names as common table expressions."""
    used = [f"{n} AS ({_for_duckdb(s)})" for n, s in LAYERS.items() if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(start):
            return f"{start}{', '.join(used)}, {sql.removeprefix(start)}"
    return f"WITH {', '.join(used)} {sql}"
