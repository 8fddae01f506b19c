"""Documents to a training mix: toxicity, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame with the columns of
``documents`` (the last adds ``copies``); it is written as Parquet and reread as the
next one's ``docs``.  Reference tables (labels, benchmark) come from ``sf_dir``.

Defined results of all stages: empty tables stay empty; other columns of any names are
kept; rows with a null text or key stay unless a stage says otherwise below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm import decontamination, mixing, ngram_jaccard_join, substring_dedup, toxicity
from cityloom.llm._common import fresh_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.  Each row is judged by its text alone, so null and
    repeated keys need no care; without labels all stay."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of 5-word shingles the document with the least id stays.
    Rows that repeat that id stay together; texts without words are linked with nothing;
    a null id goes where a linked document has one, and stays otherwise."""
    return ngram_jaccard_join.keep_one(docs, size=5, percent=80)


def trim_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out of the text; a
    document of which no word is left goes.  Rows that repeat an id with other texts, and
    rows without one, count as later than all others."""
    out = substring_dedup.trim(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 0.8 of a benchmark item's 5-word shingles go, each by its own text."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often.  Texts without words are never taken;
    a null source is a source of its own; rows with the same id, source and size are taken alike."""
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", trim_repeats),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Nearest neighbours, links and dependent rounding are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
