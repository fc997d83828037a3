"""Window frames that Spark does not parse: GROUPS bounds, EXCLUDE, FILTER, and user frames on ranking functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNBOUNDED = Window.unboundedPreceding


def filtered(aggregate: Callable[[Column], Column], x: Column, condition: Column) -> Column:
    """aggregate(x) FILTER (WHERE condition), ready for ``over``."""
    return aggregate(F.when(condition, x))


def groups_frame(
    df: DataFrame, partition: list[str], order: list[Column], aggregates: dict[str, Column], low: int, high: int,
) -> DataFrame:
    """df with aggregates over a frame counted in peer groups: from ``low`` to ``high`` groups from the row's own.

    The dense rank numbers the groups, and a RANGE frame over it counts them;
    both windows share one partitioning, so the rows are shuffled once.
    """
    ranked = df.withColumn("_group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    window = Window.partitionBy(*partition).orderBy("_group").rangeBetween(low, high)
    return ranked.withColumns({name: a.over(window) for name, a in aggregates.items()}).drop("_group")


def frame_excluding(
    df: DataFrame, partition: list[str], order: list[Column], value: str, name: str, exclude: str, low: int = UNBOUNDED, high: int = 0, reduce: str = "sum",
) -> DataFrame:
    """df with an aggregate over a ROWS frame without the current row, its peers (``group``), or its other peers (``ties``).

    sum and count of exact types subtract: what is left out are the rows of the
    same bounds within the peer group, another running window. min, max and
    sums of reals fold over the frame's values, and so suit bounded frames.
    """
    base = Window.partitionBy(*partition).orderBy(*order)
    df = df.withColumns({"_rn": F.row_number().over(base), "_peer": F.dense_rank().over(base)})
    rows = Window.partitionBy(*partition).orderBy("_rn").rowsBetween(low, high)
    peers = Window.partitionBy(*partition, "_peer").orderBy("_rn").rowsBetween(low, high)
    kind, v = df.schema[value].dataType, F.col(value)
    exact = isinstance(kind, (T.IntegralType, T.DecimalType))
    if reduce == "count" or (reduce == "sum" and exact):
        own_row = low <= 0 <= high

        def left(term: Column) -> Column:
            all_, own = F.coalesce(F.sum(term).over(rows), F.lit(0)), F.coalesce(term, F.lit(0)) if own_row else F.lit(0)
            group = F.coalesce(F.sum(term).over(peers), F.lit(0))
            return {"no others": all_, "current row": all_ - own, "group": all_ - group, "ties": all_ - group + own}[exclude]

        n = left(F.when(v.isNotNull(), F.lit(1).cast("bigint")))
        out = n if reduce == "count" else F.when(n > 0, left(v))
        return df.withColumn(name, out).drop("_rn", "_peer")
    entry = F.struct(F.col("_rn").alias("rn"), F.col("_peer").alias("peer"), v.alias("v"))
    kept = {
        "no others": lambda e: F.lit(True),
        "current row": lambda e: e["rn"] != F.col("_rn"),
        "group": lambda e: e["peer"] != F.col("_peer"),
        "ties": lambda e: (e["peer"] != F.col("_peer")) | (e["rn"] == F.col("_rn")),
    }[exclude]
    df = df.withColumn("_frame", F.collect_list(entry).over(rows))
    values = F.filter(F.transform(F.filter("_frame", kept), lambda e: e["v"]), lambda x: x.isNotNull())
    out = {
        "sum": lambda: F.when(F.size(values) > 0, F.aggregate(values, F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))),
        "min": lambda: F.array_min(values),
        "max": lambda: F.array_max(values),
    }[reduce]()
    return df.withColumn(name, out).drop("_rn", "_peer", "_frame")


def named_windows(**specs: dict) -> dict:
    """WINDOW clauses with inheritance: a spec may name a ``base``, and add an order or a frame to it."""
    made: dict = {}

    def build(name: str):
        if name not in made:
            spec = specs[name]
            w = build(spec["base"]) if "base" in spec else Window.partitionBy(*spec.get("partition", []))
            if "order" in spec:
                w = w.orderBy(*spec["order"])
            if "rows" in spec:
                w = w.rowsBetween(*spec["rows"])
            if "range" in spec:
                w = w.rangeBetween(*spec["range"])
            made[name] = w
        return made[name]

    return {name: build(name) for name in specs}
