"""Row changes as whole-table rewrites, and the change log between two states of a table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.operators.staging import staged

INSERT, UPDATE, DELETE, COMMIT = 1, 0, -1, 2


def update(df: DataFrame, where: Column, set_: Mapping[str, Column]) -> DataFrame:
    """The table with columns set in the rows where the condition is true."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*(F.when(hit, set_[c]).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in df.columns))


def update_from(df: DataFrame, source: DataFrame, key: list[str], set_: Mapping[str, str]) -> DataFrame:
    """UPDATE .. FROM by key: columns take the source's values; of several source rows for a key, the largest values."""
    new = source.groupBy(*key).agg(F.max(F.struct(*(F.col(s).alias(f"_{c}") for c, s in set_.items()))).alias("_new"))
    joined = df.join(new, key, "left")
    return joined.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new._{c}")).otherwise(F.col(c)).alias(c) if c in set_ else F.col(c) for c in df.columns))


def delete(df: DataFrame, where: Column) -> DataFrame:
    """The table without the rows where the condition is true: NULL keeps a row."""
    return df.where(~F.coalesce(where, F.lit(False)))


def deleted(df: DataFrame, where: Column) -> DataFrame:
    """DELETE .. RETURNING *."""
    return df.where(where)


def upsert(df: DataFrame, new: DataFrame, key: list[str], on_conflict: str = "update", order: str | None = None, where: Column | None = None) -> DataFrame:
    """The table after INSERT .. ON CONFLICT (key).

    ``nothing`` keeps old rows, and of new ones for a key the first;
    ``update`` and ``replace`` take the last. ``order`` says which is which
    (else all columns do). NULL keys conflict with nothing. ``where`` limits
    updates, over the new row's columns.
    """
    first = on_conflict == "nothing"
    sort = [F.col(order)] if order else [F.col(c) for c in new.columns]
    by = Window.partitionBy(*key).orderBy(*(s.asc() if first else s.desc() for s in sort))
    has_key = F.lit(True)
    for k in key:
        has_key = has_key & F.col(k).isNotNull()
    new = new.where(where) if where is not None and on_conflict == "update" else new
    picked = new.where(has_key).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")
    loose = new.where(~has_key).select(*df.columns)
    picked = picked.select(*df.columns)
    if first:
        return df.union(picked.join(df.select(*key), key, "left_anti").select(*df.columns)).union(loose)
    return df.join(picked.select(*key), key, "left_anti").select(*df.columns).union(picked).union(loose)


def changes(before: DataFrame, after: DataFrame, key: list[str], table: str, mode: str = "full") -> DataFrame:
    """The log that turns ``before`` into ``after``: change_type, table_name, id, before, after, updates.

    ``mode`` is id, before, after or full, and says which images are kept.
    updates names the columns that an update changed. Keys are unique.
    """
    values = before.columns
    a = before.select(*(F.col(k) for k in key), F.struct(*values).alias("before"))
    b = after.select(*(F.col(k) for k in key), F.struct(*values).alias("after"))
    both = a.join(b, key, "full").where(~F.col("before").eqNullSafe(F.col("after")))
    kind = F.when(F.col("before").isNull(), INSERT).when(F.col("after").isNull(), DELETE).otherwise(UPDATE)
    changed = F.filter(F.array(*(F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in values)), lambda c: c.isNotNull())
    null = lambda c: F.lit(None).cast(both.schema[c].dataType)
    return both.select(
        kind.alias("change_type"), F.lit(table).alias("table_name"), *key,
        (F.col("before") if mode in ("before", "full") else null("before")).alias("before"),
        (F.col("after") if mode in ("after", "full") else null("after")).alias("after"),
        F.when((kind == UPDATE) & F.lit(mode == "full"), changed).alias("updates"),
    )


def numbered(log: DataFrame, key: list[str], transaction: int, start: int = 1) -> DataFrame:
    """The log with change_id, change_txn_id and, last, its COMMIT record.

    Ids count by table and key; they are dealt by ranges and shifted by the
    counts of the ranges before, so no single task orders the log.
    """
    ordered = log.repartitionByRange("table_name", *key).sortWithinPartitions("table_name", *key).withColumn("_part", F.spark_partition_id())
    ordered = staged(ordered)  # the partitions' numbers are read twice
    local = ordered.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("table_name", *key)))
    counts = local.groupBy("_part").agg(F.count("*").alias("_c"))
    shift = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    out = local.join(shift, "_part").withColumn("change_id", F.col("_n") + F.col("_s") + F.lit(start - 1)).drop("_part", "_n", "_s")
    commit = log.groupBy().agg((F.count("*") + start).alias("change_id"))
    end = commit.select(*(F.col("change_id") if c == "change_id" else F.lit(COMMIT).alias(c) if c == "change_type" else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns))
    return out.unionByName(end).withColumn("change_txn_id", F.lit(transaction))


def apply_changes(df: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """The table after a log of one change a key."""
    kept = df.join(log.where(F.col("change_type") != COMMIT).select(*key), key, "left_anti").select(*df.columns)
    return kept.union(log.where(F.col("change_type").isin(INSERT, UPDATE)).select("after.*").select(*df.columns))


def violations(df: DataFrame, checks: Mapping[str, Column], unique: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(constraint, n): how many rows break each check (a check that is NULL holds), and how many keys are repeated."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items())) if checks else None
    out = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("constraint"), F.col(n).alias("n")) for n in checks))).alias("r")).select("r.*") if checks else None
    for name, cols in (unique or {}).items():
        has = F.lit(True)
        for c in cols:
            has = has & F.col(c).isNotNull()
        twice = df.where(has).groupBy(*cols).count().where("count > 1").agg(F.lit(name).alias("constraint"), F.count("*").alias("n"))
        out = twice if out is None else out.union(twice)
    return out
