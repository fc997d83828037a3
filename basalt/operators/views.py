"""Incremental view maintenance: tables as rows with integer weights, operators on changes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "_weight"


def delta(df: DataFrame, weight: int = 1) -> DataFrame:
    """Rows as insertions (or, by -1, deletions)."""
    return df.withColumn(WEIGHT, F.lit(weight).cast("long"))


def consolidate(d: DataFrame) -> DataFrame:
    """Equal rows summed up; those of weight 0 are gone."""
    columns = [c for c in d.columns if c != WEIGHT]
    return d.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def rows(d: DataFrame) -> DataFrame:
    """A state as plain rows, each as often as its weight."""
    columns = [c for c in d.columns if c != WEIGHT]
    return consolidate(d).where(F.col(WEIGHT) > 0).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(WEIGHT))).alias("_i")).drop("_i")


def filter_delta(d: DataFrame, where: Column) -> DataFrame:
    return d.where(where)


def project_delta(d: DataFrame, *columns: Column) -> DataFrame:
    return d.select(*columns, WEIGHT)


def merge_deltas(*ds: DataFrame) -> DataFrame:
    """UNION ALL of changes."""
    out = ds[0]
    for d in ds[1:]:
        out = out.unionByName(d)
    return out


def join_delta(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, on: list[str]) -> DataFrame:
    """The change of an inner join: d_left with right, left with d_right, and both changes with each other."""

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        joined = a.withColumnRenamed(WEIGHT, "_wa").join(b.withColumnRenamed(WEIGHT, "_wb"), on)
        return joined.withColumn(WEIGHT, F.col("_wa") * F.col("_wb")).drop("_wa", "_wb")

    return consolidate(product(d_left, right).unionByName(product(left, d_right)).unionByName(product(d_left, d_right)))


def distinct_delta(state: DataFrame, d: DataFrame) -> DataFrame:
    """The change of UNION's distinct rows: those whose weight passes between none and some."""
    columns = [c for c in d.columns if c != WEIGHT]
    changed = consolidate(d)
    old = state.groupBy(*columns).agg(F.sum(WEIGHT).alias("_old"))
    same = changed[columns[0]].eqNullSafe(old[columns[0]])
    for c in columns[1:]:
        same = same & changed[c].eqNullSafe(old[c])
    both = changed.join(old, same, "left").select(*(changed[c] for c in columns), changed[WEIGHT].alias("_d"), F.coalesce(old["_old"], F.lit(0)).alias("_old"))
    step = (F.col("_old") + F.col("_d") > 0).cast("long") - (F.col("_old") > 0).cast("long")
    return both.withColumn(WEIGHT, step).where(F.col(WEIGHT) != 0).select(*columns, WEIGHT)


class AggregateView:
    """COUNT, SUM, AVG, MIN and MAX by group, kept up to date by changes.

    Sums and counts follow from the weights alone. MIN and MAX need the rows
    of those groups that a change touches, which are read from the state.
    """

    def __init__(self, keys: list[str], value: str):
        self.keys, self.value = keys, value

    def full(self, state: DataFrame) -> DataFrame:
        w, v = F.col(WEIGHT), F.col(self.value)
        live = consolidate(state)
        n = F.sum(F.when(v.isNotNull(), w).otherwise(0))
        return live.groupBy(*self.keys).agg(
            F.sum(w).alias("n_rows"), n.alias("n"), F.sum(v * w).alias("total"), F.min(F.when(w > 0, v)).alias("low"), F.max(F.when(w > 0, v)).alias("high"),
        ).where("n_rows > 0")

    def apply(self, view: DataFrame, state: DataFrame, d: DataFrame) -> DataFrame:
        """The view after a change; ``state`` is the table before it."""
        touched = d.select(*self.keys).distinct()
        fresh = self.full(state.join(touched, self.keys, "left_semi").unionByName(d.select(*state.columns)))
        return view.join(touched, self.keys, "left_anti").unionByName(fresh)
