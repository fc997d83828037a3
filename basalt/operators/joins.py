"""Joins by the dialect's rules: USING and NATURAL merge columns; keys of unlike types or collations compare as it does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether Catalyst's size estimate is within a broadcast's reach."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size allows it, else as it is."""
    return F.broadcast(df) if small(df, limit) else df


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """By all common columns, each once; with none in common, all pairs."""
    common = [c for c in a.columns if c in b.columns]
    return a.join(b, common, how) if common else a.crossJoin(b)


def numeric_key(x: str | Column) -> Column:
    """A key that is equal for 1 and 1.0."""
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def nocase_key(x: str | Column) -> Column:
    """A key that is equal for texts that differ in ASCII case alone."""
    return F.translate(F.col(x) if isinstance(x, str) else x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and a range that holds it, by bins of ``width``: an equi-join, where a theta join would test all pairs.

    A range is repeated once a bin; choose the width near the usual length.
    """
    bin_ = lambda c: F.floor(F.col(c).cast("double") / width).cast("long")
    spread = ranges.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(bin_(low), bin_(high))))
    return points.withColumn("_bin", bin_(at)).join(spread, "_bin").where(F.col(at).between(F.col(low), F.col(high))).drop("_bin")


def salted_join(big: DataFrame, other: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An inner or left join whose hot keys are dealt to ``salts`` tasks: the other side is repeated so many times."""
    dealt = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    copies = other.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
