"""Compounds that bind from left to right, and limits by the dialect's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame

OPS = {
    "union all": lambda a, b: a.union(b),
    "union": lambda a, b: a.union(b).distinct(),
    "intersect": lambda a, b: a.intersect(b),
    "except": lambda a, b: a.subtract(b),
}


def compound(first: DataFrame, *steps: tuple[str, DataFrame]) -> DataFrame:
    """first op df op df ..., by position, each on all that is to its left."""
    for op, df in steps:
        first = OPS[op.lower()](first, df)
    return first


def limited(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """LIMIT and OFFSET: negative ones count as none."""
    for value in (limit, offset):
        if value is not None and (isinstance(value, bool) or int(value) != value):
            raise TypeError("datatype mismatch")
    if offset is not None and offset > 0:
        df = df.offset(int(offset))
    return df.limit(int(limit)) if limit is not None and limit >= 0 else df
