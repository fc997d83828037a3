"""Virtual tables: a Python class as a readable source whose filters the engine may hand over."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class VirtualTable:
    """What a source implements: its schema, its partitions, and the rows of one."""

    schema = "value bigint"

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[object]:
        return [None]

    def rows(self, partition: object) -> Iterator[tuple]:
        raise NotImplementedError


class SeriesTable(VirtualTable):
    """start..stop by step, a slice a partition."""

    def partitions(self) -> list[object]:
        start, stop, step = (int(self.options.get(k, d)) for k, d in (("start", 0), ("stop", -1), ("step", 1)))
        values = range(start, stop + (1 if step > 0 else -1), step)
        parts = max(1, int(self.options.get("parts", 4)))
        size = -(-len(values) // parts) or 1
        return [values[i : i + size] for i in range(0, len(values), size)]

    def rows(self, partition: object) -> Iterator[tuple]:
        return ((v,) for v in partition)


class _Slice(InputPartition):
    def __init__(self, value: object):
        self.value = value


class _Reader(DataSourceReader):
    def __init__(self, table: VirtualTable):
        self.table = table

    def partitions(self) -> list[InputPartition]:
        return [_Slice(p) for p in self.table.partitions()] or [_Slice(())]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        yield from self.table.rows(partition.value)


def register(spark: SparkSession, name: str, table: Callable[[dict], VirtualTable]) -> None:
    """Make the table readable as ``spark.read.format(name).option(...).load()``."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return table(dict(self.options)).schema

        def reader(self, schema) -> DataSourceReader:
            return _Reader(table(dict(self.options)))

    spark.dataSource.register(Source)
