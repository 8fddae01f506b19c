"""File formats beyond Parquet: GeoJSON features by line, delimited tables, XYZ rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A polygon's rings; the first is the outer one, each closed by its first point.
_FEATURE = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties string"


def write_geojson(df: DataFrame, path: str, rings: str = "rings") -> None:
    """One polygon feature a line; ``rings`` holds arrays of (x, y) structs, other columns are properties."""
    xy = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    closed = F.transform(xy, lambda ring: F.when((F.size(ring) > 0) & (F.get(ring, 0) != F.get(ring, F.size(ring) - 1)), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring))
    geometry = F.when(F.col(rings).isNotNull(), F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates")))
    properties = F.struct(*(F.col(c) for c in df.columns if c != rings))
    row = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))
    df.select(F.to_json(row).alias("value")).write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str, properties: str, rings: str = "rings") -> DataFrame:
    """Polygon features by line; ``properties`` is a schema.  A line that is no feature is left
    out, a feature without geometry has null rings."""
    f = spark.read.text(path).select(F.from_json("value", _FEATURE).alias("f")).where("f.type = 'Feature'").select("f.*")
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))
    open_ = lambda ring: F.when(F.size(ring) > 1, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)
    shape = F.transform("geometry.coordinates", lambda ring: F.transform(open_(ring), point))
    return f.select(F.from_json("properties", properties).alias("p"), shape.alias(rings)).select("p.*", rings)


def write_table(df: DataFrame, path: str) -> None:
    """A delimited table with a header; nulls are written as \\N, so empty texts stay apart."""
    df.write.mode("overwrite").csv(path, header=True, nullValue=r"\N", emptyValue='""', escape='"')


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False, nullValue=r"\N", emptyValue="", escape='"', multiLine=True)


def read_xyz(spark: SparkSession, path: str, size: float, nodata: float | None = None) -> DataFrame:
    """Lines of x, y and value, at cell centres, as cells (r, c, v)."""
    part = F.split(F.trim("value"), r"[\s,;]+")
    n = lambda i: F.get(part, i).try_cast("double")
    cells = spark.read.text(path).select(F.floor(n(1) / size).alias("r"), F.floor(n(0) / size).alias("c"), n(2).alias("v")).where("r is not null AND c is not null AND v is not null")
    return cells if nodata is None else cells.where(F.col("v") != nodata)
