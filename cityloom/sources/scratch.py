"""Cutting long lineages in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read again.  A checkpoint would keep the size that
    its plan was thought to have: joins multiply such sizes, so in loops their digits double
    each round until they fill the driver.  A table has the size of its files."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        wanted = sc.getConf().get("spark.checkpoint.dir")
        if not wanted:  # executors of a cluster see the warehouse, but no temporary folder of the driver
            wanted = tempfile.mkdtemp(prefix="cityloom-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        sc.setCheckpointDir(wanted)
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
