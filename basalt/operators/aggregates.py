"""Aggregates whose semantics differ from Spark's, as Columns over one group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: str | Column) -> Column:
    """Sum as a real, 0.0 where there is nothing."""
    return F.coalesce(F.sum(_col(x).cast("double")), F.lit(0.0))


def avg(x: str | Column) -> Column:
    return F.avg(_col(x).cast("double"))


def group_concat(x: str | Column, sep: str = ",", order: str | Column | None = None) -> Column:
    """Texts joined, NULLs skipped and empty texts kept; in the order of ``order``, else of the texts, so that results repeat."""
    kept = F.collect_list(F.when(_col(x).isNotNull(), F.struct(_col(order if order is not None else x).alias("k"), _col(x).cast("string").alias("x"))))
    return F.when(F.count(_col(x)) > 0, F.array_join(F.transform(F.array_sort(kept), lambda s: s["x"]), sep))


def array_agg(x: str | Column, order: str | Column) -> Column:
    """All values in an order, NULLs included; NULL for no rows."""
    rows = F.array_sort(F.collect_list(F.struct(_col(order).alias("k"), _col(x).alias("x"))))
    return F.when(F.count(F.lit(1)) > 0, F.transform(rows, lambda s: s["x"]))


def json_group_array(x: str | Column, order: str | Column) -> Column:
    return F.to_json(F.coalesce(array_agg(x, order), F.array()))


def json_group_object(key: str | Column, value: str | Column) -> Column:
    """An object of all pairs in the order of their keys; repeated keys stay."""
    pair = F.struct(_col(key).cast("string").alias("k"), F.coalesce(_json(_col(value)), F.lit("null")).alias("v"))
    rows = F.array_sort(F.collect_list(F.when(_col(key).isNotNull(), pair)))
    return F.concat(F.lit("{"), F.array_join(F.transform(rows, lambda s: F.concat(_json(s["k"]), F.lit(":"), s["v"])), ","), F.lit("}"))


def _json(x: Column) -> Column:
    """A scalar as JSON text: what stands in an array of it alone."""
    whole = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substr(whole, F.lit(2), F.length(whole) - 2))


def percentile_disc_floor(x: str | Column, p: float) -> Column:
    """The extension's rule: the value at index floor(p * (n - 1))."""
    at = F.floor(F.lit(p) * (F.count(_col(x)) - 1)).cast("int")
    return F.when(F.count(_col(x)) > 0, F.get(F.sort_array(F.collect_list(_col(x))), at))


def percentile_disc(x: str | Column, p: float) -> Column:
    """The SQL rule, for any ordered type: the first value whose cumulative share reaches p."""
    n = F.count(_col(x))
    at = F.greatest(F.ceil(F.lit(p) * n), F.lit(1)).cast("int") - 1
    return F.when(n > 0, F.get(F.sort_array(F.collect_list(_col(x))), at))


def percentile_cont(x: str | Column, p: float) -> Column:
    if not 0 <= p <= 1:
        raise ValueError("a percentile's fraction lies in 0 to 1")
    return F.percentile(_col(x), F.lit(p))


def percentile(x: str | Column, p: float) -> Column:
    """p in 0 to 100."""
    return percentile_cont(x, p / 100)


def mode(x: str | Column) -> Column:
    """The most frequent value, of several the smallest."""
    return F.mode(_col(x), True)


def stddev(x: str | Column) -> Column:
    return F.stddev_samp(_col(x))


def bare_columns(df: DataFrame, keys: list[str], extreme: str, columns: list[str], largest: bool = True) -> DataFrame:
    """A group's largest (or smallest) value with other columns of a row that holds it; of several such rows, the least."""
    pick = F.max if largest else F.min
    best = df.groupBy(*keys).agg(pick(extreme).alias("_best"))
    rows = df.join(best, keys).where(F.col(extreme) == F.col("_best"))
    return rows.groupBy(*keys).agg(F.first("_best").alias(extreme), F.min(F.struct(*columns)).alias("_row")).select(*keys, extreme, "_row.*")
