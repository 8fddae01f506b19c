"""The register of queries, each with SQL that says the same for DuckDB.

A query is a function of (spark, sf_dir); its SQL names layers (see ``sources.layers``)
and tables, which are put in front as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.sources.layers import with_layers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _counted(sql: str) -> str:
    """Counts of conditions as BIGINT, as Spark has them."""
    return re.sub(r"count_if\(((?:[^()]|\([^()]*\))*)\)", r"CAST(count_if(\1) AS BIGINT)", sql)


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_layers(_counted(sql))
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:  # noqa: ANN001
    return F.round(c, 6)
