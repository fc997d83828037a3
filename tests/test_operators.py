"""Operators on small tables with nulls, ties and empty inputs."""

import pytest
from pyspark.sql import functions as F

from basalt.operators import changes, fulltext, joins, setops, types, views, windows
from basalt.operators.recursive import recursive_union
from basalt.sources import tables as src
from basalt.streaming.views import StreamingAggregate, change_log, windowed_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_limits(spark):
    df = spark.range(5)
    assert setops.limited(df, -1).count() == 5 and setops.limited(df, 2).count() == 2 and setops.limited(df.orderBy("id"), 2, 4).count() == 1
    with pytest.raises(TypeError):
        setops.limited(df, 1.5)


def test_natural_join_without_common_columns(spark):
    assert joins.natural_join(spark.sql("SELECT 1 AS a"), spark.sql("SELECT * FROM VALUES (2), (3) AS t(b)")).count() == 2


def test_range_join_equals_theta(spark):
    points, ranges = spark.range(100).withColumnRenamed("id", "x"), spark.sql("SELECT * FROM VALUES (3, 30), (28, 28), (90, 200), (9, 1) AS r(lo, hi)")
    want = points.join(ranges, points.x.between(ranges.lo, ranges.hi))
    assert rows(joins.range_join(points, ranges, "x", "lo", "hi", 7).select("x", "lo", "hi")) == rows(want)


def test_salted_join(spark):
    big = spark.sql("SELECT id % 2 AS k, id FROM range(50)")
    other = spark.sql("SELECT * FROM VALUES (0L, 'a'), (5L, 'z') AS t(k, v)")
    assert rows(joins.salted_join(big, other, "k", 3).select("k", "id", "v")) == rows(big.join(other, "k").select("k", "id", "v"))


def test_groups_frame_and_exclude(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1), (2, 1), (3, 2), (4, NULL), (5, 9) AS t(id, g)").withColumn("p", F.lit(0))
    got = windows.groups_frame(df, ["p"], [F.col("g")], {"n": F.count("*")}, -1, 0)
    assert dict(got.select("id", "n").collect()) == {4: 1, 1: 3, 2: 3, 3: 3, 5: 2}
    ties = windows.frame_excluding(df, ["p"], [F.col("g")], "id", "s", "ties", -10, 10)
    assert {r.id: r.s for r in ties.collect()}[1] == 13


@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
@pytest.mark.parametrize("low,high", [(-2, 1), (1, 3), (-(1 << 63), 0)])
def test_exclude_by_subtraction_and_by_fold(spark, exclude, low, high):
    df = spark.sql("SELECT id % 3 AS p, id DIV 7 AS g, id, IF(id % 5 = 0, NULL, id) AS v, CAST(IF(id % 5 = 0, NULL, id) AS DOUBLE) AS r FROM range(60)")
    run = lambda x, how: {a.id: a.s for a in windows.frame_excluding(df, ["p"], [F.col("g")], x, "s", exclude, low, high, how).collect()}
    assert run("v", "sum") == run("r", "sum")


def test_upsert_null_keys_and_last_wins(spark):
    old = spark.sql("SELECT * FROM VALUES (1, 'a'), (CAST(NULL AS INT), 'n') AS t(k, v)")
    new = spark.sql("SELECT * FROM VALUES (1, 'b'), (1, 'c'), (2, 'd'), (CAST(NULL AS INT), 'm') AS t(k, v)")
    assert rows(changes.upsert(old, new, ["k"])) == rows(spark.sql("SELECT * FROM VALUES (1, 'c'), (2, 'd'), (CAST(NULL AS INT), 'n'), (CAST(NULL AS INT), 'm') AS t(k, v)"))
    assert (1, "a") in rows(changes.upsert(old, new, ["k"], "nothing"))
    assert rows(changes.upsert(old.limit(0), new.limit(0), ["k"])) == []


def test_change_log_round_trip(spark):
    a = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL), (3, 'c') AS t(k, v)")
    b = spark.sql("SELECT * FROM VALUES (2, 'b'), (3, 'c'), (4, 'd') AS t(k, v)")
    log = changes.changes(a, b, ["k"], "t")
    assert sorted((r.change_type, r.k) for r in log.collect()) == [(-1, 1), (0, 2), (1, 4)]
    assert rows(changes.apply_changes(a, log, ["k"])) == rows(b)
    numbered = changes.numbered(log, ["k"], 9).collect()
    assert sorted(r.change_id for r in numbered) == [1, 2, 3, 4] and max(numbered, key=lambda r: r.change_id).change_type == changes.COMMIT


def test_aggregate_view_with_deletions(spark):
    state = views.delta(spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 5), ('b', 2) AS t(k, x)"))
    gone = views.delta(spark.sql("SELECT * FROM VALUES ('a', 5), ('b', 2) AS t(k, x)"), -1)
    view = views.AggregateView(["k"], "x")
    assert rows(view.apply(view.full(state), state, gone)) == [("a", 1, 1, 1, 1, 1)]


def test_recursive_union_with_nulls(spark):
    start = spark.sql("SELECT CAST(NULL AS INT) AS x UNION ALL SELECT 1")
    assert recursive_union(start, lambda new: new.select((F.col("x") + 1) % 4)).count() == 5


def test_full_text(spark):
    docs = spark.sql("SELECT * FROM VALUES (1, 'The quick brown fox'), (2, 'a slow brown dog'), (3, NULL), (4, '') AS t(id, body)")
    ids = lambda q: sorted(r.id for r in fulltext.fts_match(docs, q, "body").collect())
    assert ids("fox dog") == [1, 2] and ids("brown AND NOT dog") == [1] and ids('"brown fox"') == [1] and ids("qui*") == [1] and ids("body:slow^3") == [2] and ids("(fox OR dog) AND slow") == [2]
    scores = {r.id: r.score for r in fulltext.fts_score(docs, "fox brown", "id", "body").collect()}
    assert set(scores) == {1, 2} and scores[1] > scores[2]
    assert docs.select(fulltext.fts_highlight(F.col("body"), "brown").alias("h")).first().h == "The quick <b>brown</b> fox"
    for bad in ("(fox", "AND", "fox AND"):
        with pytest.raises(ValueError):
            fulltext.parse(bad)
    assert spark.sql("SELECT 'Abc' AS x").select(fulltext.tokenize(F.col("x"), "ngram").alias("t")).first().t == ["ab", "bc", "abc"]


def test_types(spark):
    even = types.CustomType("int", check=lambda c: c % 2 == 0)
    assert types.written(spark.sql("SELECT 4 AS x"), {"x": even}).first().x == 4
    with pytest.raises(Exception, match="check failed"):
        types.written(spark.sql("SELECT id AS x FROM range(5)"), {"x": even}).collect()
    assert [types.affinity(t) for t in ("BIGINT", "VARCHAR(3)", "", "DOUBLE", "DECIMAL(3,1)", "CHARINT")] == ["integer", "text", "blob", "real", "numeric", "integer"]
    assert sorted(r.s for r in types.with_sequence(spark.range(7), "s", ["id"], 10, 2).collect()) == list(range(10, 24, 2))


def test_sources(spark, tmp_path):
    (tmp_path / "c.txt").write_text("1\ta\\tb\n2\t\\N\n\\.\n")
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([StructField("i", IntegerType()), StructField("t", StringType())])
    assert rows(src.copy_from(spark, str(tmp_path / "c.txt"), schema)) == [(1, "a\tb"), (2, None)]
    (tmp_path / "c.csv").write_text('a,b\n1,"x\ny"\n')
    assert rows(src.csv(spark, str(tmp_path / "c.csv"), header=True)) == [("1", "x\ny")]
    assert rows(src.generate_series(spark, 1, 5, 2)) == [(1,), (3,), (5,)] and rows(src.generate_series(spark, 5, 1)) == []
    src.register(spark)
    got = spark.sql("""SELECT t.fullkey FROM json_tree('{"a":[1]}') t""")
    assert rows(got) == [("$",), ("$.a",), ("$.a[0]",)]


def test_streams(spark, tmp_path):
    data = tmp_path / "in"
    spark.sql("SELECT id % 2 AS k, id AS v, timestamp_seconds(id) AS t FROM range(10)").write.parquet(str(data))
    stream = lambda: spark.readStream.schema("k bigint, v bigint, t timestamp").parquet(str(data))
    view = StreamingAggregate(spark, str(tmp_path / "view"), ["k"], "v")
    view.start(stream(), str(tmp_path / "c1")).awaitTermination(60)
    spark.sql("SELECT id % 2 AS k, id AS v, timestamp_seconds(id) AS t FROM range(10, 12)").write.mode("append").parquet(str(data))
    view.start(stream(), str(tmp_path / "c1")).awaitTermination(60)
    assert rows(view.state()) == [(0, 6, 30, 0, 10), (1, 6, 36, 1, 11)]
    view.merge(spark.sql("SELECT 0L AS k, 99L AS v"), 0)  # a batch run again counts once
    assert rows(view.state()) == [(0, 6, 30, 0, 10), (1, 6, 36, 1, 11)]
    change_log(stream(), str(tmp_path / "log"), str(tmp_path / "c2"), "t").awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 12
    assert windowed_counts(spark.read.parquet(str(data)), "t", "k", "5 seconds", "1 minute").agg(F.sum("n")).first()[0] == 12


def test_violations(spark):
    df = spark.sql("SELECT * FROM VALUES (1, NULL), (1, -2), (2, 3) AS t(k, x)")
    assert rows(changes.violations(df, {"x > 0": F.col("x") > 0}, {"k": ["k"]})) == [("k", 1), ("x > 0", 1)]
