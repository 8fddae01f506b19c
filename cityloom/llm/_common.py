"""Helpers shared by the operators: scratch space, folds, column names, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or where that is unset
    one below the warehouse; on a single machine, as in tests, a temporary one."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    wanted = sc.getConf().get("spark.checkpoint.dir")
    if not wanted:
        wanted = tempfile.mkdtemp(prefix="cityloom-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    sc.setCheckpointDir(wanted)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage, so that a lost
    executor costs a re-read and nothing upstream runs twice."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again.  Unlike a checkpoint the result holds
    nothing of the steps before it, so that ``release`` can let their shuffle files go."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go now, not whenever the driver next collects
    garbage.  Steps whose DataFrames (or checkpoints of them) are still held keep theirs."""
    gc.collect()
    for _ in range(2):  # Python's references are given back to the driver a moment later
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other scripts stay as they are."""
    return F.translate(c, UPPER, LOWER)


def word_array(t: Column) -> Column:
    """The words of a text in order, as ``WORD`` finds them.  Plain replacements and a split at
    one character need no regular expression for each word."""
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def fold_is(key: Column, remainder: int, modulus: int = 5) -> Column:
    """True where crc32 of the key as text leaves ``remainder``; a null key is in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A contiguous string array with nulls as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that each piece has at most ``most_bytes`` of text
    (one row at least), which bounds the memory of array kernels."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(base + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
