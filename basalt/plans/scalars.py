"""Queries over the scalar functions: text, numbers, dates, JSON, arrays, vectors, types, digests, addresses, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.registry import query, table
from basalt.plans.relational import dialect
from basalt.sources import tables as src


def golden(name: str, *pairs: tuple[str, str]) -> None:
    """One row of expressions with fixed results: ``(dialect, SQL literal of the result)``."""
    names = [f"c{i}" for i in range(len(pairs))]
    dialect(name, "SELECT " + ", ".join(f"{e} AS {n}" for (e, _), n in zip(pairs, names, strict=True)), "", "SELECT " + ", ".join(f"{v} AS {n}" for (_, v), n in zip(pairs, names, strict=True)))


# --- text -----------------------------------------------------------------------------------

dialect("fn_text_case_length", "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, octet_length(p_type) AS o FROM part", "part",
        "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS INTEGER) AS n, CAST(strlen(p_type) AS INTEGER) AS o FROM part")
dialect("fn_text_substr", "SELECT p_partkey, substr(p_type, 3) AS a, substr(p_type, 2, 4) AS b, substr(p_type, -3) AS c, substring(p_type, 1, 2) AS d FROM part", "part",
        "SELECT p_partkey, substr(p_type, 3) AS a, substr(p_type, 2, 4) AS b, right(p_type, 3) AS c, left(p_type, 2) AS d FROM part")
dialect("fn_text_search", "SELECT p_partkey, instr(p_type, 'A') AS i, replace(p_type, 'A', '__') AS r, string_reverse(p_brand) AS v, repeat(p_brand, 2) AS t FROM part", "part",
        "SELECT p_partkey, CAST(instr(p_type, 'A') AS INTEGER) AS i, replace(p_type, 'A', '__') AS r, reverse(p_brand) AS v, repeat(p_brand, 2) AS t FROM part")
dialect("fn_text_pad_trim", "SELECT n_name, lpad(n_name, 12, '*') AS l, rpad(n_name, 4, '-') AS r, trim(n_name, 'N_') AS t, ltrim(n_name, 'N') AS a, rtrim(n_name, '0123456789') AS b FROM nation", "nation")
dialect("fn_text_concat", "SELECT n_nationkey, concat(n_name, NULL, '-', n_regionkey) AS c, concat_ws('/', n_name, NULL, 'x') AS w, n_name || '!' AS p, quote(n_name) AS q FROM nation", "nation",
        "SELECT n_nationkey, concat(n_name, NULL, '-', n_regionkey) AS c, concat_ws('/', n_name, NULL, 'x') AS w, n_name || '!' AS p, '''' || n_name || '''' AS q FROM nation")
dialect("fn_text_hex", "SELECT r_name, hex(r_name) AS h, hex(r_regionkey + 100) AS i, unicode(r_name) AS u, char(65, r_regionkey + 66) AS c FROM region", "region",
        "SELECT r_name, hex(r_name) AS h, hex(CAST(r_regionkey + 100 AS VARCHAR)) AS i, unicode(r_name) AS u, 'A' || chr(CAST(r_regionkey + 66 AS INTEGER)) AS c FROM region")
golden("fn_text_edges", ("substr('hello', 0, 3)", "'he'"), ("substr('hello', 4, -2)", "'el'"), ("substr('hello', -9, 6)", "'he'"), ("upper('aé')", "'Aé'"), ("char(233, 128512)", "'é😀'"), ("unistr('\\0041b')", "'Ab'"),
       ("unistr_quote('it''s')", "'''it''''s'''"), ("soundex('Robert')", "'R163'"), ("soundex('')", "'?000'"), ("quote(NULL)", "'NULL'"), ("glob('a[0-9]?', 'a7x')", "1"), ("like('A%', 'abc')", "1"))
golden("fn_blobs", ("hex(unhex('41 42', ' '))", "'4142'"), ("hex(zeroblob(3))", "'000000'"), ("get_byte(x'414243', 1)", "66"), ("hex(set_byte(x'414243', 1, 90))", "'415A43'"), ("length(x'4142')", "2"), ("length(randomblob(8))", "8"), ("unhex('4') IS NULL", "true"))
golden("fn_printf", ("printf('%05d|%-6s|%6.2f', 42, 'ab', 3.14159)", "'00042|ab    |  3.14'"), ("format('%x %X %o', 255, 255, 8)", "'ff FF 10'"), ("printf('%e', 12345.678)", "'1.234568e+04'"), ("printf('%%%s', NULL)", "'%'"), ("printf('%+d %,d', 5, 1234567)", "'+5 1,234,567'"))

# --- conditions, types ----------------------------------------------------------------------------

dialect("fn_conditional", "SELECT o_orderkey, ifnull(nullif(o_orderstatus, 'F'), 'was F') AS a, iif(o_totalprice > 100000, 'big', 'small') AS b, coalesce(NULL, o_custkey) AS c, likely(o_orderkey) AS d FROM orders", "orders",
        "SELECT o_orderkey, ifnull(nullif(o_orderstatus, 'F'), 'was F') AS a, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS b, o_custkey AS c, o_orderkey AS d FROM orders")
dialect("fn_scalar_min_max", "SELECT p_partkey, max(p_size, 20) AS a, min(p_size, 20, 10) AS b, max(p_size, NULL) AS c FROM part", "part",
        "SELECT p_partkey, greatest(p_size, 20) AS a, least(p_size, 20, 10) AS b, CAST(NULL AS INTEGER) AS c FROM part")
golden("fn_typeof", ("typeof(1)", "'integer'"), ("typeof(1.5)", "'real'"), ("typeof('x')", "'text'"), ("typeof(x'00')", "'blob'"), ("typeof(NULL)", "'null'"), ("boolean_to_int(1 = 1)", "1"), ("int_to_boolean(3)", "true"))
golden("fn_numeric_type", ("CAST(numeric_add(numeric_encode('1.10', 10, 2), '2.25') AS DOUBLE)", "3.35::DOUBLE"), ("CAST(numeric_mul('1.5', '4') AS DOUBLE)", "6.0::DOUBLE"), ("numeric_lt('1.5', '1.50001')", "true"), ("numeric_eq('1.5', '1.50')", "true"), ("numeric_div('1', '0') IS NULL", "true"), ("CAST(numeric_sub('3', '0.5') AS DOUBLE)", "2.5::DOUBLE"))

# --- mathematics -----------------------------------------------------------------------------------

dialect("fn_math_trig", "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size / 100.0), 9) AS t, round(atan2(p_size, 3), 9) AS a, round(degrees(p_size), 6) AS d, round(radians(p_size), 9) AS r FROM part", "part",
        "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size / 100.0::DOUBLE), 9) AS t, round(atan2(p_size, 3), 9) AS a, round(degrees(p_size), 6) AS d, round(radians(p_size), 9) AS r FROM part")
dialect("fn_math_hyperbolic", "SELECT p_partkey, round(sinh(p_size / 20.0), 6) AS s, round(cosh(p_size / 20.0), 6) AS c, round(tanh(p_size / 20.0), 9) AS t, round(asinh(p_size), 9) AS a, round(acosh(p_size), 9) AS b, round(atanh(p_size / 100.0), 9) AS d, round(asin(p_size / 100.0), 9) AS e, round(acos(p_size / 100.0), 9) AS f, round(atan(p_size), 9) AS g FROM part", "part",
        "SELECT p_partkey, round(sinh(p_size / 20.0::DOUBLE), 6) AS s, round(cosh(p_size / 20.0::DOUBLE), 6) AS c, round(tanh(p_size / 20.0::DOUBLE), 9) AS t, round(asinh(p_size), 9) AS a, round(acosh(p_size), 9) AS b, round(atanh(p_size / 100.0::DOUBLE), 9) AS d, round(asin(p_size / 100.0::DOUBLE), 9) AS e, round(acos(p_size / 100.0::DOUBLE), 9) AS f, round(atan(p_size), 9) AS g FROM part")
dialect("fn_math_log_exp", "SELECT p_partkey, round(ln(p_size), 9) AS a, round(log(p_size), 9) AS b, round(log(3, p_size), 9) AS c, round(log2(p_size), 9) AS d, round(log10(p_retailprice), 9) AS e, round(exp(p_size / 10.0), 6) AS f, round(sqrt(p_retailprice), 9) AS g, pow(p_size, 2) AS h, round(pi(), 9) AS i FROM part", "part",
        "SELECT p_partkey, round(ln(p_size), 9) AS a, round(log10(p_size), 9) AS b, round(ln(p_size) / ln(3), 9) AS c, round(log2(p_size), 9) AS d, round(log10(p_retailprice), 9) AS e, round(exp(p_size / 10.0::DOUBLE), 6) AS f, round(sqrt(p_retailprice), 9) AS g, CAST(pow(p_size, 2) AS DOUBLE) AS h, round(pi(), 9) AS i FROM part")
dialect("fn_math_rounding", "SELECT s_suppkey, CAST(ceil(s_acctbal) AS BIGINT) AS a, CAST(floor(s_acctbal) AS BIGINT) AS b, CAST(trunc(s_acctbal) AS BIGINT) AS c, abs(s_acctbal) AS e, sign(s_acctbal) AS f, mod(s_suppkey, 7) AS g, gcd(s_suppkey, 36) AS h, lcm(s_suppkey, 6) AS i FROM supplier", "supplier",
        "SELECT s_suppkey, CAST(ceil(s_acctbal) AS BIGINT) AS a, CAST(floor(s_acctbal) AS BIGINT) AS b, CAST(trunc(s_acctbal) AS BIGINT) AS c, abs(s_acctbal) AS e, CAST(sign(s_acctbal) AS INTEGER) AS f, CAST(s_suppkey % 7 AS DOUBLE) AS g, gcd(s_suppkey, 36) AS h, lcm(s_suppkey, 6) AS i FROM supplier")
golden("fn_math_edges", ("sqrt(-1) IS NULL", "true"), ("acos(2) IS NULL", "true"), ("ln(0) IS NULL", "true"), ("round(2.5)", "3.0::DOUBLE"), ("round(-2.5)", "(-3.0)::DOUBLE"), ("round(1234.5, -2)", "1235.0::DOUBLE"), ("log(100)", "2.0::DOUBLE"), ("7 / 2", "3::BIGINT"), ("7 / 0 IS NULL", "true"), ("7 % 0 IS NULL", "true"), ("1 << 64", "0::BIGINT"), ("-1 >> 70", "(-1)::BIGINT"))

# --- dates -----------------------------------------------------------------------------------------

dialect("fn_date_parts", "SELECT o_orderkey, date(o_orderdate) AS d, time(o_orderdate) AS t, datetime(o_orderdate) AS dt, unixepoch(o_orderdate) AS u, julianday(o_orderdate) AS j FROM orders", "orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt, CAST(epoch(o_orderdate) AS BIGINT) AS u, epoch(o_orderdate) / 86400.0::DOUBLE + 2440587.5::DOUBLE AS j FROM orders")
dialect("fn_date_modifiers", "SELECT o_orderkey, date(o_orderdate, '+10 days') AS a, datetime(o_orderdate, 'start of month', '-1 hours') AS b, date(o_orderdate, 'start of year') AS c, date(o_orderdate, '+1 month', 'floor') AS e FROM orders", "orders",
        "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(date_trunc('month', o_orderdate)::TIMESTAMP - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS b, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS c, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS e FROM orders")
dialect("fn_date_strftime", "SELECT o_orderkey, strftime('%d/%m/%Y %H-%M', o_orderdate) AS a, strftime('%j', o_orderdate) AS j, strftime('%w', o_orderdate) AS w, strftime('%s', o_orderdate) AS s FROM orders", "orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y %H-%M') AS a, strftime(o_orderdate, '%j') AS j, strftime(o_orderdate, '%w') AS w, CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS s FROM orders")
golden("fn_date_edges", ("date('2024-01-31', '+1 month')", "'2024-03-02'"), ("date('2024-01-31', '+1 month', 'floor')", "'2024-02-29'"), ("datetime(1700000000, 'unixepoch')", "'2023-11-14 22:13:20'"), ("date(2451545)", "'2000-01-01'"), ("time('12:34')", "'12:34:00'"), ("date('bad') IS NULL", "true"),
       ("date('2024-01-03', 'weekday 1')", "'2024-01-08'"), ("datetime('2024-03-01 10:00', '-00:30')", "'2024-03-01 09:30:00'"), ("timediff('2024-03-15', '2024-01-31')", "'+0000-01-13 00:00:00.000'"), ("strftime('%e|%k|%l|%p|%u|%W', '2024-02-05 09:05:00')", "' 5| 9| 9|AM|1|06'"),
       ("datetime('2024-02-29', '+1 year')", "'2025-03-01 00:00:00'"), ("unixepoch('1970-01-02T00:00:01')", "86401::BIGINT"))
dialect("fn_time_extension", "SELECT event_id, time_get_year(ts) AS y, time_get_isoweek(ts) AS w, time_to_milli(ts) AS m, time_fmt_datetime(time_trunc(ts, 'hour')) AS h, time_fmt_datetime(time_add(ts, dur_m() * 90)) AS a, time_fmt_date(time_add_date(ts, 0, 0, 3)) AS d FROM events", "events",
        "SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(weekofyear(ts) AS BIGINT) AS w, epoch_us(ts) // 1000 AS m, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS d FROM events")
golden("fn_time_values", ("time_fmt_iso(make_timestamp(2024, 5, 6, 7, 8, 9))", "'2024-05-06T07:08:09Z'"), ("time_compare(make_date(2024, 1, 1), make_date(2024, 1, 2))", "-1"), ("time_after(make_date(2024, 1, 2), make_date(2024, 1, 1))", "1"), ("time_sub(time_unix(10), time_unix(7))", "3000000000::BIGINT"),
       ("time_get_nano(time_micro(5))", "5000::BIGINT"), ("time_get_weekday(make_date(2024, 1, 7))", "0::BIGINT"), ("time_get('quarter', make_date(2024, 5, 1))", "2::BIGINT"), ("time_fmt_datetime(time_round(time_unix(3599), dur_h()))", "'1970-01-01 01:00:00'"), ("dur_s() + dur_ms() + dur_us() + dur_ns()", "1001001001::BIGINT"))

# --- JSON ------------------------------------------------------------------------------------------

dialect("fn_json_extract", "SELECT event_id, json_extract(props, '$.k') AS a, props ->> 'k' AS b, json_type(props) AS t, json_valid(props) AS v FROM events", "events",
        "SELECT event_id, props ->> '$.k' AS a, props ->> '$.k' AS b, lower(json_type(props)) AS t, CAST(json_valid(props) AS INTEGER) AS v FROM events")
golden("fn_json_build", ("json('{\"b\": 1, \"a\": [1, 2.50]}')", "'{\"b\":1,\"a\":[1,2.50]}'"), ("json_array(1, 'x', NULL, 2.5)", "'[1,\"x\",null,2.5]'"), ("json_object('k', 1, 'v', 't')", "'{\"k\":1,\"v\":\"t\"}'"), ("json_quote('a\"b')", "'\"a\\\"b\"'"), ("json_array_length('[1,2,3]')", "3::BIGINT"), ("json_array_length('{\"a\":[1]}', '$.a')", "1::BIGINT"),
       ("json_error_position('{\"a\":}')", "6"), ("json_type('[1,2.5,null,true]', '$[1]')", "'real'"), ("json_valid('{x')", "0"), ("json_pretty('[1]')", "'[' || chr(10) || '    1' || chr(10) || ']'"))
golden("fn_json_edit", ("json_set('{\"a\":1}', '$.b', 'x')", "'{\"a\":1,\"b\":\"x\"}'"), ("json_insert('{\"a\":1}', '$.a', 2)", "'{\"a\":1}'"), ("json_replace('{\"a\":1}', '$.a', 2)", "'{\"a\":2}'"), ("json_remove('{\"a\":1,\"b\":[1,2]}', '$.b[0]')", "'{\"a\":1,\"b\":[2]}'"), ("json_patch('{\"a\":1,\"b\":2}', '{\"a\":null,\"c\":3}')", "'{\"b\":2,\"c\":3}'"),
       ("json_extract('{\"a\":[1,2,3]}', '$.a[#-1]', '$.a[0]')", "'[3,1]'"), ("'{\"a\":[5]}' -> '$.a'", "'[5]'"), ("jsonb_set('[1]', '$[#]', 2)", "'[1,2]'"))


@query("fn_json_each", "SELECT event_id, e.key AS key, CASE WHEN json_type(props, '$.' || e.key) = 'VARCHAR' THEN 'text' WHEN json_type(props, '$.' || e.key) = 'DOUBLE' THEN 'real' ELSE 'integer' END AS type, '$.' || e.key AS fullkey FROM events, unnest(json_keys(props)) AS e(key)")
def fn_json_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.json_each(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "key", "type", "fullkey")


@query("fn_json_tree", "SELECT * FROM (VALUES (0, '$', 'object', NULL), (1, '$.a', 'array', 0), (2, '$.a[0]', 'integer', 1), (3, '$.a[1]', 'object', 1), (4, '$.a[1].b', 'text', 3)) v(id, fullkey, type, parent)")
def fn_json_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.json_tree(spark.sql("""SELECT '{"a": [1, {"b": "x"}]}' AS j"""), "j").select("id", "fullkey", "type", "parent")


# --- arrays, vectors, structs -------------------------------------------------------------------------

golden("fn_arrays", ("array_length(array(1, 2, 3))", "3"), ("array_element(array(5, 6), 1)", "6"), ("array_element(array(5), 9) IS NULL", "true"), ("array_to_string(array_append(array(1, 2), 3), ',')", "'1,2,3'"), ("array_to_string(array_prepend(0, array(1)), ',')", "'0,1'"), ("array_to_string(array_cat(array(1), array(2)), ',')", "'1,2'"),
       ("array_to_string(array_remove(array(1, 2, 1), 1), ',')", "'2'"), ("array_contains(array(1, 2), 2)", "1"), ("array_position(array(5, 6), 6)", "1::BIGINT"), ("array_to_string(array_slice(array(1, 2, 3, 4), 1, 3), ',')", "'2,3'"), ("array_to_string(string_to_array('a|b', '|'), ',')", "'a,b'"), ("array_to_string(string_to_array('abc', NULL), '.')", "'a.b.c'"),
       ("array_overlap(array(1, 2), array(2, 3))", "1"), ("array_contains_all(array(1, 2, 3), array(1, 3))", "1"), ("array_to_string(array_set_element(array(1, 2), 1, 9), ',')", "'1,9'"), ("array(1, 2) @> array(2)", "1"), ("array(1) && array(2)", "0"))
golden("fn_structs", ("struct_extract(struct_pack('a', 1, 'b', 'x'), 'b')", "'x'"), ("union_tag(union_value('num', 5))", "'num'"), ("union_extract(union_value('num', 5), 'num')", "5"))
golden("fn_vectors", ("vector_extract(vector('[1,2]'))", "'[1.0,2.0]'"), ("vector_distance_l2(vector('[1,2]'), vector('[4,6]'))", "5.0::DOUBLE"), ("vector_distance_cos(vector64('[1,0]'), vector64('[0,1]'))", "1.0::DOUBLE"), ("vector_distance_dot(vector('[1,2]'), vector('[3,4]'))", "(-11.0)::DOUBLE"), ("vector_distance_jaccard(vector('[1,2]'), vector('[2,2]'))", "0.25::DOUBLE"),
       ("vector_extract(vector_slice(vector('[1,2,3]'), 1, 3))", "'[2.0,3.0]'"), ("vector_extract(vector_concat(vector('[1]'), vector('[2]')))", "'[1.0,2.0]'"), ("to_json(vector32_sparse('[0,3,0]'))", "'{\"dims\":3,\"idx\":[1],\"val\":[3.0]}'"), ("to_json(vector1bit('[-1,2]'))", "'[0,1]'"), ("to_json(struct_extract(vector8('[0,1]'), 'q'))", "'[0,255]'"))
dialect("fn_vector_nearest", "SELECT vec_id, round(vector_distance_l2(embedding, q), 6) AS d FROM embeddings CROSS JOIN (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) ORDER BY d, vec_id LIMIT 15", "embeddings",
        "SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS d FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) ORDER BY d, vec_id LIMIT 15")
dialect("fn_vector_distances", "SELECT vec_id, round(vector_distance_dot(embedding, embedding), 6) AS d, round(vector_distance_cos(embedding, q), 6) AS c FROM embeddings CROSS JOIN (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)", "embeddings",
        "SELECT vec_id, round(-list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS d, round(1 - list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS c FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)")

# --- digests, addresses, matching ------------------------------------------------------------------------

dialect("fn_crypto", "SELECT n_name, lower(hex(crypto_sha256(n_name))) AS s, lower(hex(crypto_md5(n_name))) AS m, lower(hex(crypto_sha1(n_name))) AS h, crypto_encode(n_name, 'base64') AS b, crypto_encode(n_name, 'hex') AS x FROM nation", "nation",
        "SELECT n_name, sha256(n_name) AS s, md5(n_name) AS m, sha1(n_name) AS h, to_base64(encode(n_name)) AS b, lower(hex(n_name)) AS x FROM nation")
golden("fn_crypto_codes", ("crypto_encode('hello', 'base32')", "'NBSWY3DP'"), ("CAST(crypto_decode('NBSWY3DP', 'base32') AS TEXT)", "'hello'"), ("crypto_encode('a b/c', 'url')", "'a%20b%2Fc'"), ("CAST(crypto_decode('aGk=', 'base64') AS TEXT)", "'hi'"), ("hex(crypto_sha512('abc')) LIKE 'DDAF35A1%'", "true"), ("hex(crypto_sha384('abc')) LIKE 'CB00753F%'", "true"))
golden("fn_uuid", ("length(uuid4_str())", "36"), ("length(uuid4())", "16"), ("uuid7_timestamp_ms(uuid7(1700000000))", "1700000000000::BIGINT"), ("substr(uuid7_str(1700000000), 15, 1)", "'7'"), ("uuid_str(uuid_blob('01020304-0506-4708-890a-0b0c0d0e0f10'))", "'01020304-0506-4708-890a-0b0c0d0e0f10'"))
dialect("fn_regexp", "SELECT p_partkey, regexp_like_ext('O', p_type) AS l, regexp_substr(p_type, '[AEIOU]+') AS s, regexp_replace(p_type, '[AEIOU]', '*') AS r, regexp_capture(p_brand, '#([0-9])', 1) AS c FROM part", "part",
        "SELECT p_partkey, CAST(regexp_matches(p_type, 'O') AS INTEGER) AS l, nullif(regexp_extract(p_type, '[AEIOU]+'), '') AS s, regexp_replace(p_type, '[AEIOU]', '*', 'g') AS r, nullif(regexp_extract(p_brand, '#([0-9])', 1), '') AS c FROM part")
golden("fn_ip", ("ipcontains('10.0.0.0/8', '10.1.2.3')", "1"), ("ipfamily('::1')", "6"), ("iphost('10.0.0.1/8')", "'10.0.0.1'"), ("ipmasklen('10.0.0.1/8')", "8"), ("ipnetwork('10.1.2.3/8')", "'10.0.0.0/8'"), ("ipfamily('nope') IS NULL", "true"), ("validate_ipaddr('10.0.0.1')", "'10.0.0.1'"), ("validate_ipaddr('10.0.0.256') IS NULL", "true"))
dialect("fn_fuzzy_tables", "SELECT a.n_name AS x, b.n_name AS y, fuzzy_leven(a.n_name, b.n_name) AS l, fuzzy_hamming(a.n_name, b.n_name) AS h, round(fuzzy_jarowin(a.n_name, b.n_name), 9) AS j, fuzzy_damlev(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "nation",
        "SELECT a.n_name AS x, b.n_name AS y, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS l, CASE WHEN length(a.n_name) = length(b.n_name) THEN CAST(hamming(a.n_name, b.n_name) AS INTEGER) ELSE -1 END AS h, round(jaro_winkler_similarity(a.n_name, b.n_name), 9) AS j, CAST(damerau_levenshtein(a.n_name, b.n_name) AS INTEGER) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
golden("fn_fuzzy_codes", ("fuzzy_osadist('ca', 'abc')", "3"), ("fuzzy_damlev('ca', 'abc')", "2"), ("fuzzy_soundex('Ashcraft')", "'A261'"), ("fuzzy_rsoundex('Braz')", "'B1905'"), ("fuzzy_translit('Straße Ærø')", "'Strasse AEro'"), ("fuzzy_caver('Thompson')", "'TMPSN11111'"), ("fuzzy_phonetic('phone') = fuzzy_phonetic('fone')", "true"), ("fuzzy_script('abc')", "215"))


@query("fn_generate_series", "SELECT CAST(value AS BIGINT) AS value FROM (SELECT unnest(generate_series(10, 1, -3)) AS value UNION ALL SELECT unnest(generate_series(1, 9, 2)))")
def fn_generate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.generate_series(spark, 10, 1, -3).union(src.generate_series(spark, 1, 9, 2)).union(src.generate_series(spark, 5, 1))


@query("fn_series_of_columns", "SELECT n_nationkey, CAST(unnest(generate_series(n_regionkey, 3)) AS BIGINT) AS v FROM nation WHERE n_regionkey <= 3")
def fn_series_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", F.explode(src.series(F.col("n_regionkey").cast("bigint"), F.lit(3).cast("bigint"))).alias("v"))
