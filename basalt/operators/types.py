"""Custom types, domains, sequences and generated columns as column expressions at a table's border."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators.staging import staged


@dataclass(frozen=True)
class CustomType:
    """A base type with how values are stored, read, checked and ordered."""

    base: str
    encode: Callable[[Column], Column] = lambda c: c
    decode: Callable[[Column], Column] = lambda c: c
    check: Callable[[Column], Column] | None = None
    default: Column | None = None


def written(df: DataFrame, types: Mapping[str, CustomType]) -> DataFrame:
    """Columns as they are stored; a value that breaks its type's check fails the query."""
    out = {}
    for name, t in types.items():
        value = F.col(name) if t.default is None else F.coalesce(F.col(name), t.default)
        if t.check is not None:
            bad = F.raise_error(F.concat(F.lit(f"{name}: check failed for "), value.cast("string")))
            value = F.when(value.isNull() | t.check(value), value).otherwise(bad.cast(df.schema[name].dataType))
        out[name] = t.encode(value).cast(t.base)
    return df.withColumns(out)


def read(df: DataFrame, types: Mapping[str, CustomType]) -> DataFrame:
    return df.withColumns({n: t.decode(F.col(n)) for n, t in types.items()})


def ordered(df: DataFrame, name: str, t: CustomType, descending: bool = False) -> DataFrame:
    """Stored values in the order of what they stand for."""
    key = t.decode(F.col(name))
    return df.orderBy(key.desc() if descending else key.asc())


def generated(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns))


def with_sequence(df: DataFrame, name: str, order: list[str], start: int = 1, step: int = 1) -> DataFrame:
    """df with the next values of a sequence in an order: ranges are numbered apart and shifted by the counts before them."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt)
    local = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_c"))
    shift = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return local.join(shift, "_part").withColumn(name, F.lit(start) + F.lit(step) * (F.col("_n") + F.col("_s"))).drop("_part", "_n", "_s")


AFFINITIES = (("INT", "integer"), ("CHAR", "text"), ("CLOB", "text"), ("TEXT", "text"), ("BLOB", "blob"), ("REAL", "real"), ("FLOA", "real"), ("DOUB", "real"))


def affinity(declared: str) -> str:
    """A declared type's affinity, by the first part of its name that says one; no name is a blob, any other numeric."""
    name = declared.upper()
    return next((a for part, a in AFFINITIES if part in name), "blob" if not name.strip() else "numeric")


def apply_affinity(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Columns converted at the reader: what cannot be converted becomes NULL."""
    kinds = {"integer": "bigint", "text": "string", "blob": "binary", "real": "double", "numeric": "double"}
    return df.withColumns({c: F.col(c).try_cast(kinds[affinity(t)]) for c, t in declared.items()})


def number(cls: Column, value: Column) -> Column:
    """A value of a mixed column, tagged so that NULL < numbers < texts < blobs in order."""
    return F.struct(cls.cast("int").alias("cls"), value.alias("v"))
