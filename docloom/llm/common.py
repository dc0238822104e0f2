"""Shared helpers of the corpus operators: table access, durable intermediate tables, tokenizer paths."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this package.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches of at most so many rows and bytes for this session: texts have no bound of their own, so a
    batch of the default 10,000 rows is as large as they are, in the executor and in its Python workers.

    The settings stay with the session, since a query runs when its rows are asked for, after this has returned."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def frugal(run: Callable) -> Callable:
    """The function of an Arrow UDF, giving free memory back to the machine when its task ends: workers are used again and else keep what the largest task took."""

    @wraps(run)
    def outer(batches: Iterator) -> Iterator:
        yield from run(batches)
        _give_back()

    return outer


def _give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        return


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession, qualified: bool = False) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and everything runs on one machine.

    qualified: with its file system, for readers other than Spark's."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir: executors don't share a temporary folder of one machine")
        found = "file://" + os.path.join(tempfile.gettempdir(), "docloom-checkpoints")
    if qualified:
        path = spark._jvm.org.apache.hadoop.fs.Path(found)
        found = re.sub("^file:/+", "file:///", path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
    return found.rstrip("/")


#: A key with more than one in so many of all rows is hot.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, named: DataFrame, key: str, n: str = "n") -> DataFrame:
    """rows joined on key with named, which has one row a key and in n how many of rows have it.

    Keys with more than one in HOT_SHARE of all rows are fewer than HOT_SHARE, whatever the data: these are
    broadcast, so their rows stay where they are; the others meet in a shuffle.
    """
    total = named.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(named.filter(is_hot).drop(n))
    cold = rows.join(hot.select(key), key, "left_anti").join(named.filter(~is_hot).drop(n), key)
    return rows.join(hot, key).unionByName(cold)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts the lineage: the rows survive lost executors and no later stage recomputes what made them.
    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH[-1].append(path)
    on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables made so far, by open scratch() blocks; the first list is of those that stay until the driver ends.
_SCRATCH: list[list[str]] = [[]]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the durable() tables that its block has made. What the block gives on must be written again after it, before the block ends: see kept()."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _remove(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """durable(df), of the block around the innermost scratch()."""
    out = durable(df, name)
    _SCRATCH[-2].append(_SCRATCH[-1].pop())
    return out


def on_exit(spark: SparkSession, path: str) -> None:
    """Remove path when the driver ends."""
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is already gone: the folder's owner clears it
        return


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ragged_gather(values, starts, lengths):
    """Concatenate values[s : s + n] for each (s, n) without a Python loop."""
    import numpy as np

    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if total == 0:
        return values[:0]
    ends = np.cumsum(lengths)
    shift = np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)
    return values[np.arange(total, dtype=np.int64) + shift]
