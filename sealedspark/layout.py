"""How rows are laid out: spreading small inputs, broadcasting behind a check, fixing random columns."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as there are cores, if it has fewer: before costly work on rows of a small file."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # counting the partitions would run the stages before the exchange
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def few(df: DataFrame, most: int) -> bool:
    return df.count() <= most  # a limit would gather its rows in one task


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a sort-merge join whatever its estimated size.

    Spark estimates a table by the columns read from its files, also after a checkpoint: texts and trees made from two
    keys of each row pass for small then, and would be broadcast through the driver.
    """
    return df.hint("merge")


def broadcast_if_few(df: DataFrame, most: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows; else for a shuffle join."""
    return F.broadcast(df) if few(df, most) else shuffled(df)


def blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """`df` in parts of about half of `most` rows by the hash of a key, one part if it is that small already."""
    n = df.count()
    if n <= most:
        return [df]
    parts = -(-2 * n // most)
    return [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a temporary one where a local master has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="sealedspark-")


def pin(df: DataFrame) -> DataFrame:
    """`df` evaluated once and kept in the shared checkpoint folder; random columns do not change any more."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
