"""Materialized views over streams: micro-batches of changes folded into a stored state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class StreamingAggregate:
    """COUNT, SUM, MIN and MAX by key over a stream of insertions, in a Parquet folder with a version for each batch.

    A batch is combined first, then merged with the state by key. The version
    written last is the state; a batch that is run again after a failure finds
    its version there and stops, so each counts once.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], value: str):
        self.spark, self.folder, self.keys, self.value = spark, folder.rstrip("/"), keys, value

    def _versions(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p.getName() for p in names if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n[1:]) for n in done if n.startswith("v"))

    def state(self) -> DataFrame | None:
        found = self._versions()
        return self.spark.read.parquet(f"{self.folder}/v{found[-1]}") if found else None

    def merge(self, batch: DataFrame, number: int) -> None:
        if number in self._versions():
            return
        v = F.col(self.value)
        new = batch.groupBy(*self.keys).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))
        old = self.state()
        if old is not None:
            both = old.unionByName(new)
            new = both.groupBy(*self.keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
        new.write.mode("overwrite").parquet(f"{self.folder}/v{number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def change_log(stream: DataFrame, folder: str, checkpoint: str, table: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, **trigger) -> StreamingQuery:
    """Append a stream's rows to a change log, with the micro-batch as the transaction."""

    def append(batch: DataFrame, number: int) -> None:
        rows = transform(batch)
        log = rows.select(F.lit(1).alias("change_type"), F.lit(table).alias("table_name"), F.struct(*rows.columns).alias("after"), F.lit(number).alias("change_txn_id"))
        log.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/change_txn={number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, time: str, key: str, width: str, delay: str) -> DataFrame:
    """Counts by event-time window and key; rows later than ``delay`` are dropped, so state stays bounded."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
