"""URL filters: host and path rules, then exact list membership by a Bloom filter cascade.

Level 1 holds the listed keys; level 2 holds the keys of the complete key universe
that level 1 takes for listed though they are not; level 3 the listed keys that
level 2 takes for false; and so on until no key of the universe is misjudged.  A
key's verdict is that of the first level that rejects it.  For keys of the universe
this is exact, and judging rows needs no join or shuffle: levels are bit arrays that
scalar subqueries hand to every task.

Keys are dealt into shards by a hash, so many that a shard's first level has about
``MOST_BITS`` bits at most.  Each shard has a cascade of its own, which judges the rows
of its keys in a pass of its own, so a task holds the levels of one shard, however long
the list is.  A list of up to some 5 million keys has one shard, so one pass.

Only DataFrame and SQL functions are used.  Defined results: a null url or one
without ``://`` has an empty host and path, fits no rule, is never listed, and is
allowed; repeated rows are judged alike; empty tables and empty lists work, and null and
empty keys of a list are passed over; columns of the pages keep their names and values,
and a new column whose name is taken has an underscore more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bloom import MOST_BITS, bits_for, build, holds
from ._common import ascii_lower, cut, free_name, table

#: (host, path, verdict) of the standard rules.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...], what: Column | None = None) -> Column:
    """The longest rule that fits, as its text, or with ``what`` its verdict; null where none fits."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.lit(h + p) if what is None else F.lit(verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


class Cascade:
    """``universe(key, listed)``, distinct keys, to an exact test of its keys."""

    def __init__(self, universe: DataFrame, listed: int) -> None:
        self.levels: list[tuple[DataFrame, int]] = []
        inside, outside, n = universe.where("listed").select("key"), universe.where(~F.col("listed")).select("key"), listed
        while n:
            level, bits = len(self.levels), bits_for(n)
            self.levels.append((build(inside, level, bits), bits))
            inside, outside = cut(outside.where(holds(self.levels[-1][0], F.col("key"), level, bits))), inside
            n = inside.count()

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            held, bits = self.levels[level]
            out = F.when(holds(held, key, level, bits), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """``pages`` with host, path, rule, listed and verdict.  ``listed(key)`` has the listed
    hosts; a host in it is blocked unless a rule decides."""
    host, path, rule, inside, verdict = (free_name(pages, x) for x in ("host", "path", "rule", "listed", "verdict"))
    rows = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    keys = listed.select("key").where("key is not null AND key <> ''").withColumn("listed", F.lit(True))
    hosts = rows.select(F.col(host).alias("key"), F.lit(False).alias("listed")).where("key <> ''")
    universe = cut(hosts.unionByName(keys).groupBy("key").agg(F.max("listed").alias("listed")))
    shards = max(1, -(-bits_for(universe.where("listed").count()) // most_bits))
    shard = lambda key: F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards))
    many = {r["shard"]: r["count"] for r in universe.where("listed").groupBy(shard("key").alias("shard")).count().collect()}
    parts = []
    for i in range(shards):
        cascade = Cascade(universe.where(shard("key") == i), many.get(i, 0))
        part = rows if shards == 1 else rows.where(shard(host) == i)
        parts.append(part.withColumn(inside, F.when(F.col(host) == "", False).otherwise(cascade.listed(F.col(host)))))
    rows = reduce(DataFrame.unionAll, parts)
    said = rule_of(F.col(host), F.col(path), rules, F.lit(True))
    return rows.withColumns({rule: rule_of(F.col(host), F.col(path), rules), verdict: F.coalesce(said, F.when(F.col(inside), "block").otherwise("allow"))})


def hosts_with_blocked_pages(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, url: str = "url") -> DataFrame:
    """The list of the standard query: hosts of which the rules block any page."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    return pages.where(rule_of(host, path, rules, F.lit(True)) == "block").select(host.alias("key")).distinct()


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that no rule decides are blocked if their host has a page that a rule blocks."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, hosts_with_blocked_pages(pages)).select("page_id", "host", "path", "rule", "listed", "verdict")


def _case(value: int) -> str:
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[value]}'" for h, p, v in rules) + " END"


OP5_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {_case(0)} AS rule, {_case(1)} AS ruled FROM p),
l AS (SELECT DISTINCT host FROM r WHERE ruled = 'block' AND host <> '')
SELECT page_id, host, path, rule, host IN (SELECT host FROM l) AS listed,
  coalesce(ruled, CASE WHEN host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
