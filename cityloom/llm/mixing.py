"""Mixing sources to target weights by pivotal dependent rounding.

Targets follow source weights, water-filled so that none exceeds a multiple of its
source's size.  A document's expected number of copies is its source's target over
its source's size: whole copies are certain, and the fractional parts are rounded
dependently.  In a pivotal step two documents trade expected words until one of
them has a whole number of copies, in the direction that keeps every expectation;
the other carries the residual on.  Steps run inside blocks of a hash of the
document; each block leaves one residual, and residuals meet in blocks of blocks: a
reduction tree with fan-in ``FAN``, so a source of any size is never gathered, and
its taken words miss the target by less than its largest document.

Only DataFrame and SQL functions are used.  Randomness comes from hashes of the
rows and a seed, so reruns and retries agree whatever the partitioning.

Defined results: null and word-less texts have size 0 and are never taken; repeated
rows (same key, source and size) share their number of copies; a null source is a
source of its own, ordered last; null keys are kept; if no text has words all
targets are 0; an empty table gives no rows; columns with clashing names are not
touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, cut, free_name, table

#: Documents of a block, and residuals that meet in one block of the next level.
FAN = 32
WEIGHTS = (5.0, 2.0, 1.0)


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)``, a row a source, to those and ``target``.

    The level t with sum(min(weight * t, most * size)) = share * sum(size) is found in
    closed form from running sums over sources in the order in which they fill up.
    Its windows see one narrow row for each source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("i", (F.row_number().over(order) - 1) % len(weights))
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("i").cast("int") + 1)).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    w = w.withColumns({
        "full": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        "turn": F.row_number().over(fill),
        "all": share * F.sum("source_size").over(every),
    })
    level = (F.col("all") - F.col("full")) / F.col("open")
    # The first source in filling order that its share does not fill sets the level for all after it.
    w = w.withColumn("level", F.min_by(level, F.when(level * F.col("weight") <= F.col("cap"), F.col("turn"))).over(every))
    return w.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


#: One pivotal step between the carried document ``a.cur`` and ``x``, both (id, w, p).
_STEP = """
aggregate(
  members,
  cast(null as struct<cur: struct<h: bigint, id: {id}, w: double, p: double>, done: array<struct<id: {id}, copy: int>>>),
  (a, x) -> CASE
    WHEN a IS NULL THEN named_struct('cur', x, 'done', cast(array() as array<struct<id: {id}, copy: int>>))
    ELSE transform(array(named_struct(
        'up', least(a.cur.w * (1 - a.cur.p), x.p * x.w),
        'down', least(a.cur.p * a.cur.w, x.w * (1 - x.p)),
        'u', pmod(xxhash64(a.cur.h, x.h, {seed}), 1125899906842624L) / 1125899906842624D)), d -> CASE
      WHEN d.u * (d.up + d.down) < d.down THEN CASE
        WHEN d.up >= a.cur.w * (1 - a.cur.p) THEN named_struct(
          'cur', named_struct('h', x.h, 'id', x.id, 'w', x.w, 'p', greatest(0D, (x.p * x.w - d.up) / x.w)),
          'done', concat(a.done, array(named_struct('id', a.cur.id, 'copy', 1))))
        ELSE named_struct(
          'cur', named_struct('h', a.cur.h, 'id', a.cur.id, 'w', a.cur.w, 'p', least(1D, a.cur.p + d.up / a.cur.w)),
          'done', concat(a.done, array(named_struct('id', x.id, 'copy', 0)))) END
      ELSE CASE
        WHEN d.down >= a.cur.p * a.cur.w THEN named_struct(
          'cur', named_struct('h', x.h, 'id', x.id, 'w', x.w, 'p', least(1D, x.p + d.down / x.w)),
          'done', concat(a.done, array(named_struct('id', a.cur.id, 'copy', 0))))
        ELSE named_struct(
          'cur', named_struct('h', a.cur.h, 'id', a.cur.id, 'w', a.cur.w, 'p', greatest(0D, a.cur.p - d.down / a.cur.w)),
          'done', concat(a.done, array(named_struct('id', x.id, 'copy', 1)))) END
      END)[0] END)
"""


def _level(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (source, block, h, id, w, p), with a struct as ``id``, to one row for each block, with its residual and what is done."""
    blocks = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("h", "id", "w", "p"))).alias("members"))
    return blocks.select("source", "block", F.expr(_STEP.format(seed=seed, id=rows.schema["id"].dataType.simpleString())).alias("s")).select("source", "block", "s.cur", "s.done")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken."""
    made = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words_of(F.col(text)).alias("size"))
    # Rows that agree in all three are one unit of n rows: they get the same number of copies.
    units = cut(made.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", "size", F.lit(seed))))
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    per = cut(targets(per.select("source", "source_size"), weights, share, most).join(per.select(F.col("source").alias("s"), "units"), F.expr("source <=> s")).drop("s"))
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    per = per.withColumn("ratio", ratio).withColumnRenamed("source", "s")
    biggest = per.agg(F.max("units")).first()[0] or 1
    of = units.join(per, F.expr("source <=> s")).drop("s").withColumns({"whole": F.floor("ratio").cast("int"), "p": F.col("ratio") - F.floor("ratio")})
    open_ = of.where("p > 0 AND size > 0").select("source", F.floor((F.pmod(F.xxhash64("h", F.lit("block")), F.lit(1 << 30)) / float(1 << 30)) * F.ceil(F.col("units") / FAN)).cast("long").alias("block"), F.xxhash64("h", F.lit("h")).alias("h"), F.struct("doc_id", "size").alias("id"), (F.col("size") * F.col("n")).cast("double").alias("w"), "p")
    done, rows, blocks, step = None, open_, -(-biggest // FAN), 0
    while True:
        at = cut(_level(rows, seed + step))
        settled = at.select("source", F.explode("done").alias("d")).select("source", "d.id", "d.copy")
        done = settled if done is None else done.unionAll(settled)
        if blocks <= 1:
            last = at.select("source", "cur.id", (F.pmod(F.xxhash64("cur.h", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) < F.col("cur.p")).cast("int").alias("copy"))
            done = done.unionAll(last)
            break
        rows = at.select("source", F.floor(F.col("block") / FAN).alias("block"), "cur.h", "cur.id", "cur.w", "cur.p")
        blocks, step = -(-blocks // FAN), step + 1
    # Joined on all three columns, so that units whose hashes agree stay apart.
    done = done.select(F.col("source").alias("s"), F.col("id.doc_id").alias("k"), F.col("id.size").alias("z"), "copy")
    out = of.join(done, F.expr("size = z AND doc_id <=> k AND source <=> s"), "left")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("copy", F.lit(0))).otherwise(0)
    out = out.withColumn("copies", copies.cast("int")).withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "copies", "taken")


def mixture(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes, with ``copies``, how often.
    A column of that name in ``docs`` is kept; the new one then has an underscore more."""
    name = free_name(docs, "copies")
    sized = docs.withColumn(free_name(docs, "size"), words_of(F.col(text)))
    size = sized.columns[-1]
    k, s, n = (free_name(sized, x) for x in ("mix_key", "mix_source", "mix_size"))
    got = mix(docs, key, text, source, **more).where("copies > 0").select(F.col("doc_id").alias(k), F.col("source").alias(s), F.col("size").alias(n), F.col("copies").alias(name)).distinct()
    return sized.join(got, F.col(key).eqNullSafe(F.col(k)) & F.col(source).eqNullSafe(F.col(s)) & (F.col(size) == F.col(n))).select(*docs.columns, name)
