"""Bloom filters of keys by DataFrame functions: built as one row, tested by scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, free_name

BITS_PER_KEY, PROBES = 12, 6
#: 8 MB a filter at most: the bound of what is sent to each task.
MOST_BITS = 1 << 26


def bits_for(n: int) -> int:
    return max(64, -(-n * BITS_PER_KEY // 64) * 64)


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """Double hashing: PROBES positions of a key in a level of ``bits`` bits."""
    a, b = F.xxhash64(key, F.lit(level)), F.xxhash64(key, F.lit(-1 - level))
    return [F.pmod(F.shiftright(a, 2) + i * F.shiftright(b, 6), F.lit(bits)) for i in range(PROBES)]


def build(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the level's bits as an array of longs."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("v"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "w")
    full = every.join(words, "w", "left").select(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")).alias("x"))
    return cut(full.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]).alias("bits")))


def holds(held: DataFrame, key: Column, level: int, bits: int) -> Column:
    array, out = held.scalar(), None
    for at in _positions(key, level, bits):
        word = F.get(array, F.call_function("div", at, F.lit(64)).cast("int"))
        one = F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
        out = one if out is None else out & one
    return out


def may_hold(keys: DataFrame, key: Column) -> Column:
    """Whether ``key`` may be one of ``keys(key)``: true for all that are, and few others.
    A filter has at most MOST_BITS bits, so of very many keys more others pass: it saves
    work only, and exact joins follow it."""
    bits = min(MOST_BITS, bits_for(keys.count()))
    return holds(build(keys, 0, bits), key, 0, bits)


def only_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` that may have a key of ``keys(key)``, so that a following join shuffles little."""
    return df.where(may_hold(keys, F.col(column)))


def without_keys(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key, null included, is none of ``keys(key)``.  Only the rows
    that may have one go through a join."""
    maybe, name = may_hold(keys, F.col(column)), free_name(df, "gone")
    some = df.where(maybe).join(keys.select(F.col("key").alias(name)), F.col(column).eqNullSafe(F.col(name)), "left_anti")
    return df.where(~maybe).unionByName(some)
