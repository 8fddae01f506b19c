"""Joins with checked keys, chains of outer joins, lookups with defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def left_validated(left: DataFrame, right: DataFrame, keys: list[str], how: str = "many_to_one") -> DataFrame:
    """Left join after a check that keys are unique on the right (and, ``one_to_one``, on the
    left).  Null keys match nothing.  Raises ValueError with a key that repeats."""
    for side, df in (("right", right), ("left", left)):
        if side == "right" or how == "one_to_one":
            bad = repeated_keys(df.dropna(subset=keys), keys).limit(1).collect()
            if bad:
                raise ValueError(f"{how}: {side} key repeats: {bad[0].asDict()}")
    return left.join(right, keys, "left")


def outer_chain(tables: list[DataFrame], key: str) -> DataFrame:
    """Full outer joins of all tables on one key column, which no row has null."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), tables)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """``df`` with the value that ``table`` has for the key, or the default."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), default))


def union_common(first: DataFrame, second: DataFrame) -> DataFrame:
    """The columns that both tables have, in the order of the first, and all rows."""
    common = [c for c in first.columns if c in second.columns]
    return first.select(*common).unionAll(second.select(*common))


def replace_parents(parents: DataFrame, children: DataFrame, key: str, parent: str) -> DataFrame:
    """Parents that have children give way to them; ``is_child`` and ``parent`` keep the lineage."""
    kept = parents.join(children.select(F.col(parent).alias(key)).distinct(), key, "left_anti").withColumns({"is_child": F.lit(False), parent: F.lit(None).cast(children.schema[parent].dataType)})
    return kept.unionByName(children.withColumn("is_child", F.lit(True)))


def names_inside(names: DataFrame, name: str, parts: DataFrame, part: str) -> DataFrame:
    """Rows of both tables where a name holds a part, by an equi join on the distinct pieces of
    each name: names are short, so their pieces are few, and no pair is made that does not match."""
    n = F.length(name)
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substr(F.col(name), i, k))))
    cut = names.where(n > 0).withColumn("_piece", F.explode(F.array_distinct(pieces)))
    return cut.join(parts.where(F.length(part) > 0), F.col("_piece") == F.col(part)).drop("_piece")
