"""Urban footprint analytics on Spark: relational, spatial, raster, statistics and graph operators."""
