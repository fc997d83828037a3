"""Queries over scans, predicates, joins, aggregates, windows, sorts, set operations and common tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.engine import Engine
from basalt.operators import aggregates as agg
from basalt.operators import joins, setops
from basalt.operators import windows as win
from basalt.operators.recursive import recursive_union
from basalt.plans.registry import ORACLE, QUERIES, query, table


def dialect(name: str, text: str, names: str, oracle: str | None = None) -> None:
    """Register a query in the dialect, run by the engine; DuckDB takes the same text unless it means another thing there."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).load(sf_dir, *names.split()).sql(text)

    QUERIES[name] = run
    ORACLE[name] = oracle or text


# --- TPC-H by the columns there are ---------------------------------------------------

#: Money has two decimals and discounts have two: four make the sums exact, and alike in any order.
REVENUE = "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE)"
dialect("tpch_q3", f"""
    SELECT l_orderkey, {REVENUE} AS revenue, o_orderdate FROM customer, orders, lineitem
    WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
      AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""", "customer orders lineitem")  # fmt: skip
dialect("tpch_q5", f"""
    SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
      AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
    GROUP BY n_name""", "customer orders lineitem supplier nation region")  # fmt: skip
dialect("tpch_q6", """
    SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))) AS DOUBLE) AS revenue FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00'
      AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""", "lineitem")  # fmt: skip
dialect("tpch_q7", f"""
    SELECT s.n_name AS supp_nation, c.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS revenue
    FROM supplier, lineitem, orders, customer, nation s, nation c
    WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = s.n_nationkey
      AND c_nationkey = c.n_nationkey AND s.n_regionkey <> c.n_regionkey AND s.n_nationkey < 5 AND c.n_nationkey < 5
    GROUP BY s.n_name, c.n_name, year(l_shipdate)""", "supplier lineitem orders customer nation")  # fmt: skip
dialect("tpch_q8", """
    SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year,
           round(sum(CASE WHEN n2.n_nationkey < 5 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share
    FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
    WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
      AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND s_nationkey = n2.n_nationkey AND p_size < 25
    GROUP BY year(o_orderdate)""", "part supplier lineitem orders customer nation region")  # fmt: skip
dialect("tpch_q14", """
    SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
    FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1995-09-01 00:00:00'""", "lineitem part")  # fmt: skip
dialect("tpch_q18", """
    SELECT c_name, c_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice, round(sum(l_quantity), 2) AS qty
    FROM customer, orders, lineitem
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
      AND c_custkey = o_custkey AND o_orderkey = l_orderkey
    GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""", "customer orders lineitem")  # fmt: skip

# The other shapes: dates of receipt, ship modes, phones, containers and part prices by supplier are not in these tables;
# neighbouring columns stand for them, so that joins, subqueries and predicates keep their form.
dialect("tpch_q1_grouping", f"SELECT l_returnflag, l_linestatus, {REVENUE} AS revenue, round(avg(l_tax), 6) AS tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "lineitem")
dialect("tpch_q2", """
    SELECT s_acctbal, s_name, n_name, l_partkey FROM supplier, nation, region, (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps, part
    WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_type LIKE '%ECONOMY' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
      AND s_acctbal = (SELECT max(s2.s_acctbal) FROM supplier s2, (SELECT DISTINCT l_partkey AS k, l_suppkey AS s FROM lineitem) ps2 WHERE ps2.k = p_partkey AND s2.s_suppkey = ps2.s)
    ORDER BY s_acctbal DESC, n_name, s_name, l_partkey LIMIT 100""", "supplier nation region lineitem part",
        """SELECT s_acctbal, s_name, n_name, l_partkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
           JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
           JOIN (SELECT l_partkey AS k, max(s_acctbal) AS best FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) b ON b.k = l_partkey AND best = s_acctbal
           WHERE p_type ILIKE '%ECONOMY' AND r_name = 'EUROPE' ORDER BY s_acctbal DESC, n_name, s_name, l_partkey LIMIT 100""")  # fmt: skip
dialect("tpch_q4", """
    SELECT o_orderpriority, count(*) AS order_count FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-10-01 00:00:00'
      AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""", "orders lineitem")  # fmt: skip
dialect("tpch_q9", """
    SELECT n_name AS nation, year(o_orderdate) AS o_year, CAST(sum(CAST(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity AS DECIMAL(18, 4))) AS DOUBLE) AS profit
    FROM part, supplier, lineitem, orders, nation
    WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_type LIKE '%romo%' GROUP BY 1, 2""", "part supplier lineitem orders nation",
        """SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, CAST(sum(CAST(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity AS DECIMAL(18, 4))) AS DOUBLE) AS profit
           FROM part, supplier, lineitem, orders, nation
           WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_type ILIKE '%romo%' GROUP BY 1, 2""")  # fmt: skip
dialect("tpch_q10", f"""
    SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
      AND l_returnflag = 'R' AND c_nationkey = n_nationkey
    GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""", "customer orders lineitem nation")  # fmt: skip
dialect("tpch_q11", """
    SELECT l_partkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS value FROM lineitem, supplier, nation
    WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY l_partkey
    HAVING sum(CAST(l_extendedprice AS DECIMAL(18, 2))) > (SELECT sum(CAST(l_extendedprice AS DECIMAL(18, 2))) * 0.002 FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')""", "lineitem supplier nation")  # fmt: skip
dialect("tpch_q12", """
    SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low
    FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY l_linestatus""", "orders lineitem")  # fmt: skip
dialect("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%low%' GROUP BY c_custkey) c GROUP BY c_count", "customer orders",
        "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT ILIKE '%low%' GROUP BY c_custkey) c GROUP BY c_count")
dialect("tpch_q15", """
    WITH revenue AS (SELECT l_suppkey AS supplier_no, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS total_revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, CAST(total_revenue AS DOUBLE) AS total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""", "supplier lineitem")  # fmt: skip
dialect("tpch_q16", """
    SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part
    WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
    GROUP BY p_brand, p_type, p_size""", "lineitem part supplier")  # fmt: skip
dialect("tpch_q17", """
    SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / 7.0 AS avg_yearly FROM lineitem, part
    WHERE p_partkey = l_partkey AND p_size < 10 AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""", "lineitem part")  # fmt: skip
dialect("tpch_q19", f"""
    SELECT {REVENUE} AS revenue FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 25)
       OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 35) OR (p_partkey = l_partkey AND p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 40)""", "lineitem part")  # fmt: skip
dialect("tpch_q20", """
    SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey
      AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'promo%') GROUP BY l_suppkey, l_partkey HAVING sum(l_quantity) > 60)""", "supplier nation lineitem part",
        """SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey
             AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type ILIKE 'promo%') GROUP BY l_suppkey, l_partkey HAVING sum(l_quantity) > 60)""")  # fmt: skip
dialect("tpch_q21", """
    SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
    WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND s_nationkey = n_nationkey
      AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
      AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
    GROUP BY s_name""", "supplier lineitem orders nation")  # fmt: skip
dialect("tpch_q22", """
    SELECT c_nationkey, count(*) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS totacctbal FROM customer
    WHERE c_nationkey IN (13, 1, 23, 9, 3, 18, 17) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
    GROUP BY c_nationkey""", "customer orders")  # fmt: skip

# --- dialect selects that are rewritten as a whole ------------------------------------------

dialect("sql_total_filter", "SELECT o_custkey, total(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS t FROM orders GROUP BY o_custkey", "orders", "SELECT o_custkey, coalesce(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'P'), 0)::DOUBLE AS t FROM orders GROUP BY o_custkey")
dialect("sql_group_concat_order", "SELECT n_regionkey, group_concat(n_name, '|' ORDER BY n_name DESC) AS names, group_concat(DISTINCT n_regionkey) AS k FROM nation GROUP BY n_regionkey", "nation",
        "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names, string_agg(DISTINCT CAST(n_regionkey AS VARCHAR), ',') AS k FROM nation GROUP BY n_regionkey")
dialect("sql_json_filter", "SELECT n_regionkey, json_group_array(n_nationkey ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 5) AS a FROM nation GROUP BY n_regionkey", "nation",
        "SELECT n_regionkey, CAST(to_json(coalesce(list(n_nationkey ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 5), [])) AS VARCHAR) AS a FROM nation GROUP BY n_regionkey")
dialect("sql_filter_over", "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 150000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders", "orders")
dialect("sql_groups_frame", "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM orders", "orders",
        "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
dialect("sql_exclude_ties", "SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM orders o WHERE o.o_orderstatus = 'F'", "orders")
_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND length(t) <= 40)"
dialect("sql_fts_match", "SELECT doc_id FROM documents WHERE fts_match(text, 'the AND (and OR on) NOT with OR \"of the\" OR thou*')", "documents",
        f"""SELECT doc_id FROM (SELECT doc_id, {_WORDS} AS t FROM documents) WHERE (list_contains(t, 'the') AND (list_contains(t, 'and') OR list_contains(t, 'on')) AND NOT list_contains(t, 'with'))
            OR contains(' ' || list_aggregate(t, 'string_agg', ' ') || ' ', ' of the ') OR len(list_filter(t, lambda w: starts_with(w, 'thou'))) > 0""")  # fmt: skip
dialect("sql_bare_columns", "SELECT o_custkey, o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey", "orders", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey")
dialect("sql_second_cte", "WITH RECURSIVE r(n) AS (SELECT 0 UNION SELECT (n + 7) % 25 FROM r), named(k, t) AS (SELECT n, n_name FROM r JOIN nation ON n = n_nationkey) SELECT k, t FROM named WHERE k < 10", "nation", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS t FROM nation WHERE n_nationkey < 10")


@query("sql_statements", """SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_regionkey = 2 THEN upper(r_name) ELSE coalesce(n_name, 'none') END AS t, CAST(n_regionkey * 2 AS DOUBLE) AS v
    FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3 UNION ALL SELECT 3, 'third', 9.5 UNION ALL SELECT 100, 'none', NULL""")
def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared table filled, changed by UPDATE FROM, replaced by key, ignored by key, and with defaults."""
    engine = Engine(spark).load(sf_dir, "nation", "region")
    engine.execute("CREATE TABLE named (k INTEGER PRIMARY KEY, t TEXT NOT NULL DEFAULT 'none', v REAL CHECK (v >= 0))")
    engine.execute("INSERT INTO named SELECT n_nationkey, n_name, n_regionkey * 2 FROM nation")
    engine.execute("UPDATE named SET t = upper(r_name) FROM region WHERE r_regionkey * 2 = named.v AND r_regionkey = 2")
    engine.execute("REPLACE INTO named VALUES (3, 'third', '9.5')")
    engine.execute("INSERT OR IGNORE INTO named (k, t) VALUES (4, 'not taken'), (100, 'none')")
    return engine.sql("SELECT k, t, v FROM named")

# --- scans, projections, predicates ------------------------------------------------------

dialect("scan_full", "SELECT * FROM supplier", "supplier")
dialect("scan_covering", "SELECT o_orderkey, o_orderstatus FROM orders", "orders")
dialect("scan_key_lookup", "SELECT * FROM orders WHERE o_orderkey = 7", "orders")
dialect("scan_range_seek", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200", "orders")
dialect("scan_in_seek", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 5, 9) OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", "orders customer")
dialect("scan_multi_index", "SELECT o_orderkey FROM orders WHERE (o_custkey = 10 OR o_orderkey = 20) AND o_totalprice > 0", "orders")
dialect("scan_constant_row", "SELECT 1 AS a, 'x' AS b", "")
dialect("scan_values", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS v(n, t)", "", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS v(n, t)")
dialect("subquery_source", "SELECT a.k, count(*) AS n FROM (SELECT o_custkey % 10 AS k FROM orders WHERE o_totalprice > 1000) a GROUP BY a.k", "orders")
dialect("project_expressions", "SELECT o_orderkey AS k, o_totalprice * 2 AS twice, -o_custkey AS neg FROM orders", "orders")
dialect("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", "lineitem")
dialect("predicate_null_logic", """
    SELECT x, is_true(x > 1) AS t, is_false(x > 1) AS f, CAST(x IS NULL AS INTEGER) AS n,
           CAST(x IS NOT DISTINCT FROM NULL AS INTEGER) AS d FROM (VALUES (1), (2), (NULL)) v(x)""", "",
    """SELECT x, CAST((x > 1) IS NOT DISTINCT FROM true AS INTEGER) AS t, CAST((x > 1) IS NOT DISTINCT FROM false AS INTEGER) AS f,
              CAST(x IS NULL AS BIGINT) AS n, CAST(x IS NULL AS BIGINT) AS d FROM (VALUES (1), (2), (NULL)) v(x)""")  # fmt: skip
dialect("predicate_is_operator", "SELECT a, b FROM (VALUES (1, 1), (1, NULL), (NULL, NULL)) v(a, b) WHERE a IS b", "", "SELECT a, b FROM (VALUES (1, 1), (1, NULL), (NULL, NULL)) v(a, b) WHERE a IS NOT DISTINCT FROM b")
dialect("predicate_like", "SELECT c_custkey FROM customer WHERE c_mktsegment LIKE 'b%g' AND c_name NOT LIKE '%9'", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%g' AND c_name NOT ILIKE '%9'")
dialect("predicate_like_escape", "SELECT x FROM (VALUES ('50%'), ('505'), ('a_b')) v(x) WHERE x LIKE '50!%' ESCAPE '!' OR x LIKE 'A!_B' ESCAPE '!'", "", "SELECT x FROM (VALUES ('50%'), ('505'), ('a_b')) v(x) WHERE x ILIKE '50!%' ESCAPE '!' OR x ILIKE 'A!_B' ESCAPE '!'")
dialect("predicate_glob", "SELECT c_custkey FROM customer WHERE c_mktsegment GLOB '[A-B]*' AND c_mktsegment NOT GLOB '*Y'", "customer", "SELECT c_custkey FROM customer WHERE c_mktsegment GLOB '[A-B]*' AND NOT c_mktsegment GLOB '*Y'")
dialect("predicate_regexp", "SELECT s_suppkey FROM supplier WHERE s_name REGEXP '[02468]$'", "supplier", "SELECT s_suppkey FROM supplier WHERE regexp_matches(s_name, '[02468]$')")
dialect("predicate_between_in", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 9 AND p_brand NOT IN ('Brand#11', 'Brand#12')", "part")
dialect("predicate_row_values", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders)", "lineitem orders")
dialect("predicate_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)", "customer orders")
dialect("predicate_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", "customer orders")
dialect("predicate_not_in_null", "SELECT n FROM (VALUES (1), (2)) a(n) WHERE n NOT IN (SELECT m FROM (VALUES (1), (NULL)) b(m))", "")
dialect("expression_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS s, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders", "orders")
dialect("expression_cast", "SELECT x, CAST(x AS INTEGER) AS i, CAST(x AS REAL) AS r FROM (VALUES ('12abc'), ('abc'), ('-3.7e1z'), ('  42'), (NULL)) v(x)", "",
        "SELECT * FROM (VALUES ('12abc', 12::BIGINT, 12.0::DOUBLE), ('abc', 0, 0.0), ('-3.7e1z', -3, -37.0), ('  42', 42, 42.0), (NULL, NULL, NULL)) v(x, i, r)")
dialect("expression_int_division", "SELECT o_orderkey, int_div(o_orderkey, 7) AS q, o_orderkey % 7 AS m, int_div(o_orderkey, o_custkey - o_custkey) AS z FROM orders", "orders",
        "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS m, CAST(NULL AS BIGINT) AS z FROM orders")
dialect("expression_bits", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, ~o_orderkey AS n, o_orderkey << 2 AS l, o_orderkey >> 1 AS r FROM orders", "orders")
dialect("expression_overflow", "SELECT add_promote(x, 1) AS s, mul_promote(x, 2) AS p FROM (VALUES (9223372036854775807), (5)) v(x)", "",
        "SELECT * FROM (VALUES (9223372036854775808.0::DOUBLE, 18446744073709551614.0::DOUBLE), (6.0, 10.0)) v(s, p)")
dialect("expression_scalar_subquery", "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation", "nation customer")
dialect("expression_collate", "SELECT c_mktsegment = 'building' COLLATE NOCASE AS same, count(*) AS n FROM customer GROUP BY 1", "customer", "SELECT lower(c_mktsegment) = 'building' AS same, count(*) AS n FROM customer GROUP BY 1")

# --- joins -----------------------------------------------------------------------------

dialect("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", "orders customer")
dialect("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", "orders customer")
dialect("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 200000", "orders customer")
dialect("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 150000) a FULL JOIN (SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 40) b ON a.k = b.k", "orders lineitem")
dialect("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", "region nation")
dialect("join_using", "SELECT k, a.x, b.y FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b USING (k)", "region nation")
dialect("join_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b", "region nation")
dialect("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "nation")
dialect("join_theta", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND a.s_nationkey = b.s_nationkey", "supplier")
dialect("join_null_keys", "SELECT a.x, b.y FROM (VALUES (1), (NULL)) a(x) JOIN (VALUES (1), (NULL)) b(y) ON a.x = b.y", "")


@query("join_range_binned", "SELECT e.event_id, w.lo FROM events e JOIN (SELECT event_id AS lo, event_id + 1500 AS hi FROM events WHERE event_id % 1000 = 0) w ON e.event_id BETWEEN w.lo AND w.hi")
def join_range_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range begins at every thousandth event and spans the next 1,500, over all events."""
    events = table(spark, sf_dir, "events").select("event_id")
    ranges = events.where("event_id % 1000 = 0").select(F.col("event_id").alias("lo"), (F.col("event_id") + 1500).alias("hi"))
    return joins.range_join(events, ranges, "event_id", "lo", "hi", 1000).select("event_id", "lo")


@query("join_semi", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(line, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("join_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 AND l_partkey IS NOT NULL)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(line, "p_partkey", "left_anti").select("p_partkey")


@query("join_mixed_numeric_keys", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON CAST(p_size AS DOUBLE) = CAST(s_suppkey AS DOUBLE)")
def join_mixed_numeric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    return a.join(b, joins.numeric_key("p_size") == joins.numeric_key("s_suppkey")).select("p_partkey", "s_suppkey")


@query("join_nocase_keys", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON lower(substr(n_name, 1, 1)) = lower(substr(r_name, 1, 1))")
def join_nocase_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").withColumn("k", F.substring("n_name", 1, 1))
    b = table(spark, sf_dir, "region").withColumn("j", F.lower(F.substring("r_name", 1, 1)))
    return a.join(joins.checked_broadcast(b), joins.nocase_key("k") == joins.nocase_key("j")).select("n_nationkey", "r_regionkey")


@query("join_salted_hot_key", "SELECT u.user_id, count(*) AS n FROM events e JOIN (SELECT DISTINCT user_id FROM events) u USING (user_id) GROUP BY u.user_id")
def join_salted_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    users = events.select("user_id").distinct()
    return joins.salted_join(events, users, "user_id", 4).groupBy("user_id").agg(F.count("*").alias("n"))


# --- aggregates ---------------------------------------------------------------------------

dialect("agg_ungrouped_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, total(o_totalprice) AS t, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "orders",
        "SELECT count(*) AS n, sum(o_totalprice) AS s, coalesce(sum(o_totalprice), 0.0::DOUBLE) AS t, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
dialect("agg_group_by_having", "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 10", "orders")
dialect("agg_group_only", "SELECT p_brand FROM part GROUP BY p_brand", "part")
dialect("agg_null_group", "SELECT k, count(*) AS n, count(k) AS c FROM (VALUES (1), (NULL), (NULL)) v(k) GROUP BY k", "")
dialect("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag", "lineitem")
dialect("agg_filter", "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS big, CAST(sum(l_linenumber) FILTER (WHERE l_discount = 0) AS BIGINT) AS s FROM lineitem GROUP BY l_linestatus", "lineitem")
dialect("agg_min_max_sum", "SELECT l_returnflag, min(l_shipdate) AS a, max(l_shipdate) AS b, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag", "lineitem")
dialect("agg_stddev_median", "SELECT p_brand, round(stddev(p_retailprice), 6) AS sd, round(median(p_retailprice), 6) AS m, round(percentile(p_size, 75), 6) AS p75, round(percentile_cont(p_size, 0.25), 6) AS q FROM part GROUP BY p_brand", "part",
        "SELECT p_brand, round(stddev_samp(p_retailprice), 6) AS sd, round(median(p_retailprice), 6) AS m, round(quantile_cont(p_size, 0.75), 6) AS p75, round(quantile_cont(p_size, 0.25), 6) AS q FROM part GROUP BY p_brand")
dialect("agg_percentile_disc_index", "SELECT p_brand, percentile_disc(p_size, 0.3) AS d FROM part GROUP BY p_brand", "part",
        "SELECT p_brand, list_sort(list(p_size))[CAST(floor(0.3 * (count(p_size) - 1)) AS INTEGER) + 1] AS d FROM part GROUP BY p_brand")
dialect("agg_within_group", "SELECT p_brand, mode() WITHIN GROUP (ORDER BY p_size) AS m, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice) AS c FROM part GROUP BY p_brand", "part",
        "WITH n AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM n) SELECT r.p_brand, r.p_size AS m, c FROM r JOIN (SELECT p_brand, quantile_cont(p_retailprice, 0.5) AS c FROM part GROUP BY p_brand) USING (p_brand) WHERE k = 1")


@query("agg_group_concat", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_group_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(agg.group_concat("n_name", "|").alias("names"))


@query("agg_array_and_json", """SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS a,
    '{' || string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey""")
def agg_array_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(agg.json_group_array("n_nationkey", "n_nationkey").alias("a"), agg.json_group_object("n_name", "n_nationkey").alias("o"))


@query("agg_bare_columns", "SELECT o_custkey, max(o_totalprice) AS o_totalprice, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders GROUP BY o_custkey")
def agg_bare_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.bare_columns(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


# --- windows -----------------------------------------------------------------------------------

OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
dialect("window_ranking", f"SELECT o_orderkey, CAST(row_number() {OVER} AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS BIGINT) AS dr FROM orders", "orders")
dialect("window_distribution", f"SELECT o_orderkey, round(percent_rank() {OVER}, 9) AS pr, round(cume_dist() {OVER}, 9) AS cd, CAST(ntile(4) {OVER} AS BIGINT) AS nt FROM orders", "orders")
dialect("window_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) {OVER} AS a, lag(o_orderkey, 2, -1) {OVER} AS b, lead(o_orderkey, 1) {OVER} AS c FROM orders", "orders")
FRAME = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"
dialect("window_values", f"SELECT o_orderkey, first_value(o_orderkey) {FRAME} AS f, last_value(o_orderkey) {FRAME} AS l, nth_value(o_orderkey, 2) {FRAME} AS n FROM orders", "orders")
dialect("window_rows_frame", f"SELECT o_orderkey, count(*) {FRAME} AS n, max(o_custkey + o_orderkey) {FRAME} AS m, round(sum(o_totalprice) {FRAME}, 2) AS s FROM orders", "orders")
dialect("window_range_frame", "SELECT l_orderkey, l_linenumber, CAST(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s FROM lineitem", "lineitem")
dialect("window_default_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS peers, CAST(sum(o_orderkey) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS s FROM orders", "orders")
dialect("window_named", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS a, count(*) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "orders")
dialect("window_over_group", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (PARTITION BY count(*) ORDER BY o_custkey) AS BIGINT) AS r FROM orders GROUP BY o_custkey", "orders")
dialect("window_distinct_output", "SELECT DISTINCT o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders", "orders")


@query("window_groups_frame", "SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS n, max(event_id) OVER w AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def window_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return win.groups_frame(events, ["user_id"], [F.col("event_type")], {"n": F.count("*"), "m": F.max("event_id")}, -1, 1).select("event_id", "n", "m")


def _exclude(kind: str) -> None:
    @query(f"window_exclude_{kind.replace(' ', '_')}", f"SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE {kind.upper()}) AS BIGINT) AS s FROM orders")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        return win.frame_excluding(orders, ["o_custkey"], [F.col("o_orderstatus"), F.col("o_orderkey")], "o_orderkey", "s", kind, -3, 3).select("o_orderkey", "s")


for _kind in ("current row", "group", "ties", "no others"):
    _exclude(_kind)


@query("window_filter_over", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
def window_filter_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", win.filtered(F.count, F.lit(1), F.col("o_orderstatus") == "F").over(w).alias("n"))


@query("window_running_concat", "SELECT n_nationkey, string_agg(n_name, ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS names FROM nation")
def window_running_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.collect_list("n_name").over(w), ",").alias("names"))


# --- sorts, limits, sets, common tables -----------------------------------------------------------

dialect("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
dialect("sort_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5", "orders")
dialect("sort_limit_negative", "SELECT r_name FROM region ORDER BY 1 LIMIT -1", "region", "SELECT r_name FROM region ORDER BY 1")
dialect("sort_limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
dialect("sort_nulls", "SELECT x FROM (VALUES (2), (NULL), (1)) v(x) ORDER BY x LIMIT 2", "", "SELECT x FROM (VALUES (2), (NULL), (1)) v(x) ORDER BY x NULLS FIRST LIMIT 2")
dialect("sort_nulls_last", "SELECT x FROM (VALUES (2), (NULL), (1)) v(x) ORDER BY x ASC NULLS LAST LIMIT 2", "")
A, B_, C = "SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 12", "SELECT r_regionkey AS k FROM region", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 2"
dialect("set_union_all", f"{A} UNION ALL {B_}", "nation region")
dialect("set_union", f"{A} UNION {B_}", "nation region")
dialect("set_intersect", f"{A} INTERSECT {C}", "nation region")
dialect("set_except", f"{B_} EXCEPT {C}", "nation region")
dialect("set_left_deep", f"{A} UNION {B_} INTERSECT {C}", "nation region", f"(({A}) UNION ({B_})) INTERSECT ({C})")
dialect("set_order_limit", f"{A} UNION {C} ORDER BY 1 DESC LIMIT 4", "nation region")
dialect("cte_chain", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS MATERIALIZED (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT * FROM b", "orders")
dialect("cte_recursive_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f + n FROM t WHERE n < 20) SELECT n, f FROM t", "")
dialect("cte_recursive_cycle", "WITH RECURSIVE r(x) AS (SELECT 1 UNION SELECT (x * 3) % 17 FROM r) SELECT CAST(x AS BIGINT) AS x FROM r", "")


@query("recursive_reachability", "WITH RECURSIVE r(a, b) AS (SELECT n_nationkey, (n_nationkey * 2) % 25 FROM nation UNION SELECT r.a, (n.n_nationkey * 2) % 25 FROM r JOIN nation n ON n.n_nationkey = r.b) SELECT a, b FROM r")
def recursive_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("x"), ((F.col("n_nationkey") * 2) % 25).alias("y"))
    start = edges.toDF("a", "b")
    return recursive_union(start, lambda new: new.join(edges, new["b"] == edges["x"]).select("a", "y"))


@query("set_compound_frames", "(SELECT n_regionkey AS k FROM nation EXCEPT SELECT 0 AS k) UNION ALL SELECT r_regionkey AS k FROM region")
def set_compound_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation").selectExpr("n_regionkey AS k"), table(spark, sf_dir, "region").selectExpr("r_regionkey AS k")
    return setops.compound(nation, ("except", spark.sql("SELECT 0 AS k")), ("union all", region))
