"""Every registered query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def sql_query(name: str, spark_sql: str, names: str, oracle: str | None = None) -> None:
    """Register Spark SQL over the named tables; the oracle is the same text unless given."""

    def run(spark: SparkSession, sf_dir: str, text: str = spark_sql) -> DataFrame:
        tables(spark, sf_dir, *names.split())
        return spark.sql(text)

    QUERIES[name] = run
    ORACLE[name] = oracle or spark_sql


def query(name: str, oracle: str | None) -> Callable:
    """Register a DataFrame function with its oracle SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


sql_query(
    "q1_pricing_summary",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS sum_base_price,
           CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS sum_disc_price,
           round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus
    """,
    "lineitem",
)
