"""Exact statistics with pairwise-complete and null rules."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantiles(c: str) -> list[Column]:
    p = lambda q: F.percentile(c, F.lit(q))
    return [F.count(c).alias("n"), F.median(c).alias("median"), p(0.25).alias("q25"), p(0.75).alias("q75"), (p(0.75) - p(0.25)).alias("iqr"), F.avg(c).alias("mean")]


def box_stats(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """Quartiles, and whiskers at the last values inside 1.5 interquartile ranges."""
    q = df.where(F.col(c).isNotNull()).groupBy(*by).agg(F.percentile(c, F.lit(0.25)).alias("q1"), F.median(c).alias("med"), F.percentile(c, F.lit(0.75)).alias("q3"))
    span = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, by).where(F.col(c).between(F.col("q1") - span, F.col("q3") + span))
    return inside.groupBy(*by, "q1", "med", "q3").agg(F.min(c).alias("low"), F.max(c).alias("high"))


def pair_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each pair of columns that are both known: pa, pb, a, b."""
    pairs = F.array(*(F.struct(F.lit(p).alias("pa"), F.lit(q).alias("pb"), F.col(p).alias("a"), F.col(q).alias("b")) for p, q in combinations(columns, 2)))
    return df.select(F.inline(pairs)).where("a is not null and b is not null")


def correlations(df: DataFrame, columns: list[str], least: int = 3) -> DataFrame:
    """Pearson and Spearman (average ranks within the complete pairs) of all column pairs."""
    rank = lambda c: F.rank().over(Window.partitionBy("pa", "pb").orderBy(c)) + (F.count("*").over(Window.partitionBy("pa", "pb", c)) - 1) / 2
    r = pair_rows(df, columns).withColumns({"ra": rank("a"), "rb": rank("b")})
    return r.groupBy("pa", "pb").agg(F.count("*").alias("n"), F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman")).where(F.col("n") >= least)
