"""Readers and writers, and table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions import jsontext as jt


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A scan that reads only the named columns; filters on it reach the row groups."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, filename: str | None = None, data: str | None = None, header: bool = False, columns: int | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV from files or from a text: quoted fields may hold separators, quotes ("") and line breaks. Without a schema all columns are text, c0, c1, ... or by the header."""
    reader = spark.read.option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    if (filename is None) == (data is None):
        raise ValueError("give either filename or data")
    if filename is not None:
        df = reader.csv(filename)
    else:
        import csv as rows
        import io

        parsed = list(rows.reader(io.StringIO(data)))
        names = parsed.pop(0) if header and parsed else [f"c{i}" for i in range(columns or max(map(len, parsed), default=1))]
        df = spark.createDataFrame([[*r, *[None] * (len(names) - len(r))][: len(names)] for r in parsed], T.StructType([T.StructField(n, T.StringType()) for n in names]))
        if schema is not None:
            target = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
            df = df.select(*(F.expr(f"try_cast(`{n}` AS {f.dataType.simpleString()})").alias(f.name) for n, f in zip(df.columns, target, strict=True)))
        return df
    if not header and schema is None:
        df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    if columns is not None and len(df.columns) != columns:
        raise ValueError(f"{len(df.columns)} columns, not {columns}")
    return df


def copy_from(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = "\t", null: str = "\\N", header: bool = False) -> DataFrame:
    """COPY .. FROM text: a delimiter, a text for NULL, backslash escapes, and ``\\.`` as the end."""
    lines = spark.read.text(path).where(F.col("value") != "\\.")
    if header:
        first = lines.first()
        lines = lines.where(F.col("value") != F.lit(first[0])) if first else lines
    fields = F.split("value", "(?<!\\\\)" + ("\\" + delimiter if delimiter in "|.^$*+?()[]{}\\" else delimiter))

    def field(i: int, kind: T.DataType) -> Column:
        raw = F.get(fields, F.lit(i))
        plain = raw
        for code, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\\" + delimiter, delimiter), ("\\\\", "\\")):
            plain = F.replace(plain, F.lit(code), F.lit(char))
        value = F.when(raw == null, None).otherwise(plain)
        return value if isinstance(kind, T.StringType) else value.try_cast(kind)

    return lines.select(*(field(i, f.dataType).alias(f.name) for i, f in enumerate(schema)))


def generate_series(spark: SparkSession, start: int, stop: int = (1 << 32) - 1, step: int = 1) -> DataFrame:
    """start..stop by step as ``value``; step 0 counts as 1, and a step that leads away gives no rows."""
    step = step or 1
    end = stop + (1 if step > 0 else -1)
    return spark.range(start, end, step).withColumnRenamed("id", "value")


def series(start: Column, stop: Column, step: Column | int = 1) -> Column:
    """The same as an array, for columns: explode it."""
    step = F.lit(step) if isinstance(step, int) else step
    step = F.when(step == 0, 1).otherwise(step)
    right = ((step > 0) & (start <= stop)) | ((step < 0) & (start >= stop))
    return F.when(right, F.sequence(start, F.when(right, stop).otherwise(start), F.when(right, step))).otherwise(F.array().cast("array<bigint>"))


NODE = "key string, value string, type string, atom string, id int, parent int, fullkey string, path string"


def _nodes(text: str, path: str, deep: bool) -> Iterator[tuple]:
    top = jt.find(jt.parse(text), path)
    if top is jt.MISSING:
        return
    count = iter(range(1 << 31))

    def row(key, v, ident, parent, full, base):
        atom = None if isinstance(v, list) else jt.plain(v)
        return (None if key is None else str(key), jt.plain(v), jt.kind(v), atom, ident, parent, full, base)

    def name(key, base):
        if isinstance(key, int):
            return f"{base}[{key}]"
        return f"{base}.{key}" if key.replace("_", "a").isalnum() and not key[0].isdigit() else f'{base}."{key}"'

    def children(v):
        if isinstance(v, jt.Pairs):
            return list(v)
        return list(enumerate(v)) if isinstance(v, list) else []

    def walk(key, v, parent, full, base):
        ident = next(count)
        yield row(key, v, ident, parent, full, base)
        for k, x in children(v):
            yield from walk(k, x, ident, name(k, full), full)

    if deep:
        yield from walk(None, top, None, path, path)
    elif isinstance(top, list):
        for k, x in children(top):
            yield row(k, x, next(count), None, name(k, path), path)
    else:
        yield row(None, top, 0, None, path, path)


def register(spark: SparkSession) -> None:
    """json_each and json_tree for LATERAL joins in SQL."""

    @F.udtf(returnType=NODE)
    class JsonEach:
        def eval(self, text: str, path: str = "$"):
            if text is not None:
                yield from _nodes(text, path, False)

    @F.udtf(returnType=NODE)
    class JsonTree:
        def eval(self, text: str, path: str = "$"):
            if text is not None:
                yield from _nodes(text, path, True)

    spark.udtf.register("json_each", JsonEach)
    spark.udtf.register("json_tree", JsonTree)


def json_each(df: DataFrame, json: str, path: str = "$") -> DataFrame:
    """df with a row for each child of its JSON column: key, value, type, atom, id, parent, fullkey, path."""
    return _lateral(df, json, path, False)


def json_tree(df: DataFrame, json: str, path: str = "$") -> DataFrame:
    """df with a row for each node below its JSON column, parents first."""
    return _lateral(df, json, path, True)


def _lateral(df: DataFrame, json: str, path: str, deep: bool) -> DataFrame:
    @F.pandas_udf(f"array<struct<{NODE.replace(' string', ':string').replace(' int', ':int')}>>")
    def nodes(column):
        names = [n.split()[0] for n in NODE.split(", ")]
        return column.map(lambda t: [] if t is None else [dict(zip(names, r, strict=True)) for r in _nodes(t, path, deep)])

    return df.withColumn("_node", F.explode(nodes(nodes_input(json)))).select(*df.columns, *(F.col(f"_node.{n.split()[0]}").alias(n.split()[0]) for n in NODE.split(", ")))


def nodes_input(json: str) -> Column:
    return F.col(json).cast("string")


def table_info(df: DataFrame) -> DataFrame:
    """PRAGMA table_info: cid, name, type, notnull."""
    rows = [(i, f.name, f.dataType.simpleString(), int(not f.nullable)) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "cid int, name string, type string, notnull int")


def types(spark: SparkSession) -> DataFrame:
    """The engine's types by name and storage."""
    rows = [("integer", "bigint"), ("real", "double"), ("text", "string"), ("blob", "binary"), ("boolean", "boolean"), ("date", "date"), ("timestamp", "timestamp"), ("numeric", "decimal"), ("json", "string"), ("jsonb", "variant"), ("uuid", "string"), ("inet", "string")]
    return spark.createDataFrame(rows, "name string, base string")
