"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. A local session without one gets a temporary folder; a cluster must name one."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="basalt-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there from now on.

    Spark deletes the files once df is no longer used, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set (it must be when the context starts).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(df: DataFrame, column: str) -> int:
    """The bytes of a text column, counted: estimates from compressed files mislead where they decide how much a task holds."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def partitions(df: DataFrame, size: int, target: int = 16 << 20) -> int:
    """A partition count for shuffles of ``size`` bytes: the session's, or more if they would pass ``target`` bytes each."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // target), 1 << 20))


def labelled_sample(df: DataFrame, most: int, order: str = "_h") -> list:
    """Rows of df for a fit on the driver, at most ``most``: those of the smallest 64-bit hashes in ``order``.

    If there are more, a bound on the hash that about ``most`` rows pass comes
    first, so that no task sends more than its share.
    """
    n = df.count()
    if n > most:
        df = df.where(df[order] <= min(2**63 - 1, int(-(2**63) + 2**64 * 1.1 * most / n)))
    return df.orderBy(*df.columns).limit(most).collect()
