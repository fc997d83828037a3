"""Queries over row changes, change logs, incremental views, full-text search, sources and custom types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.operators import changes, fulltext, views
from basalt.operators import types as kinds
from basalt.plans.registry import query, table
from basalt.plans.relational import dialect
from basalt.sources import tables as src
from basalt.sources import virtual


@query("dml_update", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return changes.update(rows, F.col("c_mktsegment") == "BUILDING", {"c_acctbal": F.col("c_acctbal") + 10}).drop("c_mktsegment")


@query("dml_update_from", "SELECT n_nationkey, CASE WHEN r_name IS NOT NULL THEN r_name ELSE n_name END AS n_name, n_regionkey FROM nation LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey < 2) ON n_regionkey = k")
def dml_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").where("r_regionkey < 2").withColumnRenamed("r_regionkey", "n_regionkey")
    return changes.update_from(table(spark, sf_dir, "nation"), region, ["n_regionkey"], {"n_name": "r_name"})


@query("dml_delete", "SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice > 100000, false)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.delete(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000).select("o_orderkey")


@query("dml_delete_returning", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def dml_delete_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.deleted(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100000).select("o_orderkey")


UPSERT_ROWS = "SELECT CAST(n_nationkey + 20 AS INTEGER) AS n_nationkey, 'new' || n_nationkey AS n_name, n_regionkey FROM nation"


@query("dml_upsert_update", f"SELECT * FROM nation WHERE n_nationkey < 20 UNION ALL ({UPSERT_ROWS})")
def dml_upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    new = nation.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.concat(F.lit("new"), F.col("n_nationkey")).alias("n_name"), "n_regionkey")
    return changes.upsert(nation, new, ["n_nationkey"])


@query("dml_upsert_nothing", f"SELECT * FROM nation UNION ALL SELECT * FROM ({UPSERT_ROWS}) WHERE n_nationkey > 24")
def dml_upsert_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    new = nation.select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.concat(F.lit("new"), F.col("n_nationkey")).alias("n_name"), "n_regionkey")
    return changes.upsert(nation, new, ["n_nationkey"], "nothing")


@query("dml_constraints", "SELECT 'positive' AS \"constraint\", count(*) FILTER (WHERE NOT s_acctbal > 0) AS n FROM supplier UNION ALL SELECT 'name', count(*) FROM (SELECT s_nationkey FROM supplier GROUP BY s_nationkey HAVING count(*) > 1)")
def dml_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.violations(table(spark, sf_dir, "supplier"), {"positive": F.col("s_acctbal") > 0}, {"name": ["s_nationkey"]})


@query("cdc_changes", """
    SELECT CASE WHEN a.n_nationkey IS NULL THEN 1 WHEN b.n_nationkey IS NULL THEN -1 ELSE 0 END AS change_type, coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey,
           CASE WHEN a.n_nationkey IS NOT NULL AND b.n_nationkey IS NOT NULL THEN 'n_name' END AS updates
    FROM nation a FULL JOIN (SELECT n_nationkey + 2 AS n_nationkey, 'x' || n_regionkey AS n_name, n_regionkey FROM nation) b ON a.n_nationkey = b.n_nationkey""".replace("'n_name' END", "'n_name' || CASE WHEN a.n_regionkey IS DISTINCT FROM b.n_regionkey THEN ',n_regionkey' ELSE '' END END"))  # fmt: skip
def cdc_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "nation")
    after = before.select((F.col("n_nationkey") + 2).alias("n_nationkey"), F.concat(F.lit("x"), F.col("n_regionkey")).alias("n_name"), "n_regionkey")
    return changes.changes(before, after, ["n_nationkey"], "nation").select("change_type", "n_nationkey", F.array_join("updates", ",").alias("updates"))


@query("cdc_numbered_log", "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS change_id, 1 AS change_type, r_regionkey FROM region UNION ALL SELECT count(*) + 1, 2, NULL FROM region")
def cdc_numbered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    log = changes.changes(region.limit(0), region, ["r_regionkey"], "region")
    return changes.numbered(log, ["r_regionkey"], 7).select("change_id", "change_type", "r_regionkey")


@query("cdc_replay", "SELECT n_nationkey + 2 AS n_nationkey, n_name FROM nation")
def cdc_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    after = before.select((F.col("n_nationkey") + 2).alias("n_nationkey"), "n_name")
    return changes.apply_changes(before, changes.changes(before, after, ["n_nationkey"], "nation"), ["n_nationkey"])


@query("ivm_join", "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE NOT (o_orderkey % 10 = 3)")
def ivm_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of two tables, first over most rows, then brought up to date by insertions and deletions."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    left, right = views.delta(orders.where("o_orderkey % 10 <> 4")), views.delta(people.where("k % 5 <> 1"))
    d_left = views.delta(orders.where("o_orderkey % 10 = 4")).unionByName(views.delta(orders.where("o_orderkey % 10 = 3"), -1))
    d_right = views.delta(people.where("k % 5 = 1"))
    empty_left, empty_right = left.limit(0), right.limit(0)
    first = views.join_delta(empty_left, left, empty_right, right, ["k"])
    change = views.join_delta(left, d_left, right, d_right, ["k"])
    return views.rows(views.merge_deltas(first, change)).select("o_orderkey", "c_nationkey")


@query("ivm_aggregate", "SELECT event_type, count(*) AS n_rows, count(user_id) AS n, CAST(sum(user_id) AS BIGINT) AS total, min(user_id) AS low, max(user_id) AS high FROM events WHERE event_id % 7 <> 2 GROUP BY event_type")
def ivm_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id")
    state = views.delta(events.where("event_id % 7 <> 3")).drop("event_id")
    change = views.delta(events.where("event_id % 7 = 3")).unionByName(views.delta(events.where("event_id % 7 = 2"), -1)).drop("event_id")
    view = views.AggregateView(["event_type"], "user_id")
    return view.apply(view.full(state), state, change)


@query("ivm_distinct_union", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 4 <> 0")
def ivm_distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    state = views.delta(orders.select("o_custkey"))
    change = views.delta(orders.where("o_orderkey % 4 = 0").select("o_custkey"), -1)
    first = views.distinct_delta(state.limit(0), state)
    return views.rows(first.unionByName(views.distinct_delta(state, change)))


@query("ivm_filter_project", "SELECT o_orderkey, o_custkey + 1 AS k FROM orders WHERE o_totalprice > 1000 AND o_orderkey % 2 = 0")
def ivm_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    change = views.delta(orders).unionByName(views.delta(orders.where("o_orderkey % 2 = 1"), -1))
    kept = views.filter_delta(change, F.col("o_totalprice") > 1000)
    return views.rows(views.project_delta(kept, F.col("o_orderkey"), (F.col("o_custkey") + 1).alias("k")))


# --- full-text search -----------------------------------------------------------------------------------

TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND length(t) <= 40)"


@query("fts_boolean", f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE list_contains(t, 'the') AND (list_contains(t, 'and') OR list_contains(t, 'on')) AND NOT list_contains(t, 'with')")
def fts_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.fts_match(table(spark, sf_dir, "documents").select("doc_id", "text"), "the AND (and OR on) NOT with", "text").select("doc_id")


@query("fts_phrase_prefix", f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE len(list_filter(t, lambda w: starts_with(w, 'thou'))) > 0 OR contains(' ' || list_aggregate(t, 'string_agg', ' ') || ' ', ' of the ')")
def fts_phrase_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.fts_match(table(spark, sf_dir, "documents").select("doc_id", "text"), 'thou* OR "of the"', "text").select("doc_id")


@query("fts_bm25", f"""
    WITH d AS (SELECT doc_id, {TOKENS} AS t FROM documents),
         c AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda w: w = 'that')) AS a, len(list_filter(t, lambda w: w = 'which')) AS b FROM d),
         s AS (SELECT count(*) AS docs, avg(n) AS size, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
    SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / size))
                       + 2 * ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / size)), 6) AS score
    FROM c, s WHERE a > 0 OR b > 0""")
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fulltext.fts_score(table(spark, sf_dir, "documents").select("doc_id", "text"), "that which^2", "doc_id", "text")
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query("fts_index", f"SELECT 'text' AS field, term, doc_id, count(*) AS tf, CAST(any_value(n) AS INTEGER) AS length FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) GROUP BY term, doc_id")
def fts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.index(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query("fts_highlight", "SELECT item_id, regexp_replace(text, '(^|[^\\p{L}\\p{N}])([Tt][Hh][Ee]|[Oo][Ff])($|[^\\p{L}\\p{N}])', '\\1<b>\\2</b>\\3', 'g') AS h FROM (SELECT item_id, regexp_replace(text, '([^\\p{L}\\p{N}])', '\\1\\1', 'g') AS text FROM benchmark)")
def fts_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Separators are doubled, so that SQL's single pass sees neighbouring words apart."""
    rows = table(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace("text", r"([^\p{L}\p{N}])", "$1$1"))
    return rows.select("item_id", fulltext.fts_highlight(F.col("text"), "the of").alias("h"))


# --- sources and types ---------------------------------------------------------------------------------------


@query("source_csv_text", "SELECT * FROM (VALUES ('1', 'a,b'), ('2', 'say \"hi\"'), ('3', NULL)) v(id, t)")
def source_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.csv(spark, data='id,t\n1,"a,b"\n2,"say ""hi"""\n3\n', header=True)


@query("source_virtual_series", "SELECT CAST(unnest(generate_series(5, 50, 5)) AS BIGINT) AS value")
def source_virtual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    virtual.register(spark, "series", virtual.SeriesTable)
    return spark.read.format("series").option("start", 5).option("stop", 50).option("step", 5).load()


@query("source_table_info", "SELECT * FROM (VALUES (0, 'r_regionkey', 'int', 0), (1, 'r_name', 'string', 0)) v(cid, name, type, \"notnull\")")
def source_table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table_info(table(spark, sf_dir, "region"))


@query("type_custom_cents", "SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS s_acctbal FROM supplier")
def type_custom_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = kinds.CustomType("bigint", encode=lambda c: F.round(c * 100), decode=lambda c: c / 100, check=lambda c: c > -1e9)
    return kinds.written(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), {"s_acctbal": cents})


@query("type_sequence", "SELECT n_nationkey, CAST(100 + 5 * (row_number() OVER (ORDER BY n_name) - 1) AS BIGINT) AS id FROM nation")
def type_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds.with_sequence(table(spark, sf_dir, "nation"), "id", ["n_name"], 100, 5).select("n_nationkey", "id")


@query("type_affinity", "SELECT * FROM (VALUES (12::BIGINT, 1.5::DOUBLE, '7'), (NULL, NULL, 'x')) v(a, b, c)")
def type_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("12", "1.5", "7"), ("z", "q", "x")], "a string, b string, c string")
    return kinds.apply_affinity(rows, {"a": "BIGINT", "b": "DOUBLE PRECISION", "c": "VARCHAR(5)"})


@query("type_generated", "SELECT p_partkey, p_retailprice * 2 AS twice FROM part")
def type_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds.generated(table(spark, sf_dir, "part"), {"twice": F.col("p_retailprice") * 2}).select("p_partkey", "twice")


@query("mixed_class_order", "SELECT * FROM (VALUES (1, 1, NULL), (2, 2, '5'), (3, 3, 'abc')) v(pos, cls, t)")
def mixed_class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = spark.createDataFrame([(3, "abc"), (1, None), (2, "5")], T.StructType([T.StructField("cls", T.IntegerType()), T.StructField("t", T.StringType())]))
    order = Window.orderBy(kinds.number(F.col("cls"), F.col("t")))
    return rows.select(F.row_number().over(order).alias("pos"), "cls", "t")


dialect("postgres_casts", "SELECT n_nationkey::text AS t, '12'::integer AS i, 'ab'::varchar AS v FROM nation", "nation", "SELECT n_nationkey::VARCHAR AS t, 12::BIGINT AS i, 'ab' AS v FROM nation")
