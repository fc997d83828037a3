"""SQL text in, DataFrame out: the dialect over a Spark session's views."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.functions import udfs
from basalt.operators.recursive import recursive_union
from basalt.operators.staging import staged
from basalt.operators import changes, types
from basalt.operators.schemas import KINDS, ConstraintError, Schema, Sequence
from basalt.plans.dialect import flat, nest, rewrite, show, split_by, tokens, upper
from basalt.sources import tables

__all__ = ["ConstraintError", "Engine"]


class Engine:
    """Queries over named tables.

    >>> engine = Engine(spark).load("/data", "orders", "customer")
    >>> engine.sql("SELECT substr(c_name, 0, 3) FROM customer LIMIT -1")
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        if not spark.catalog.functionExists("bs_json"):
            udfs.register(spark)
            tables.register(spark)
        self.tables: dict[str, DataFrame] = {}
        self.schemas: dict[str, Schema] = {}
        self.domains: dict[str, list] = {}
        self.sequences: dict[str, Sequence] = {}
        self.materialized: dict[str, str] = {}
        self.attached: set[str] = set()

    def load(self, folder: str, *names: str) -> Engine:
        """Views over folder/NAME.parquet."""
        for name in names:
            self.table(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    def table(self, name: str, df: DataFrame) -> Engine:
        df.createOrReplaceTempView(name)
        self.tables[name.lower()] = df
        return self

    def create_function(self, name: str, f: Callable, returns: str) -> None:
        """A scalar function of Python values, called in Arrow batches."""
        self.spark.udf.register(name, udfs.arrow_udf(f, returns))

    def create_aggregate(self, name: str, start: Callable, step: Callable, finish: Callable, returns: str) -> None:
        """An aggregate by a state, a step for each value and a last step; a group's values meet in one task."""

        def fold(values: pd.Series) -> object:
            state = start()
            for v in values:
                state = step(state, v)
            return finish(state)

        # The annotations say that a column becomes one value.
        fold.__annotations__ = {"values": pd.Series, "return": float if returns == "double" else int if returns == "bigint" else str}
        self.spark.udf.register(name, F.pandas_udf(fold, returns))

    def execute(self, text: str) -> DataFrame:
        """A statement over registered tables, or a query.

        INSERT, REPLACE, UPDATE [FROM], DELETE, each with RETURNING; CREATE TABLE, VIEW,
        MATERIALIZED VIEW, SEQUENCE and DOMAIN; ALTER, DROP, ATTACH, DETACH, ANALYZE,
        EXPLAIN, PRAGMA. A changed table is a rewrite of the one before, under
        the same name. The rows that changed are returned: all of their columns,
        or what RETURNING asks for. Declared constraints are tested by a query
        before the change is taken; a materialized view is made anew after it.
        """
        nodes = nest(tokens(text.strip().rstrip(";")))
        words = [upper(n) for n in nodes]
        if words[0] in ("DELETE", "UPDATE", "INSERT", "REPLACE"):
            at = words.index("RETURNING") if "RETURNING" in words else len(nodes)
            changed = {"DELETE": self._delete, "UPDATE": self._update}.get(words[0], self._insert)(nodes[:at], words[:at])
            self._refresh()
            if at == len(nodes):
                return changed
            changed.createOrReplaceTempView("_returned")
            return self.sql(f"SELECT {_plain(nodes[at + 1 :])} FROM _returned")
        if words[0] == "ALTER":
            return self._alter(nodes)
        if words[0] == "EXPLAIN":
            k = 3 if words[1:3] == ["QUERY", "PLAN"] else 1
            return self.spark.createDataFrame([(line,) for line in self.explain(_plain(nodes[k:])).splitlines()], "detail string")
        if words[0] == "CREATE":
            return self._create(nodes, words)
        if words[0] == "DROP":
            name = nodes[-1].strip("`").lower()
            for kept in (self.tables, self.schemas, self.materialized, self.sequences, self.domains):
                kept.pop(name, None)
            self.spark.catalog.dropTempView(nodes[-1].strip("`"))
            return self.spark.range(0)
        if words[0] == "ATTACH":
            return self._attach(*(n.strip("`'") for n in nodes if isinstance(n, str) and upper(n) not in ("ATTACH", "DATABASE", "AS")))
        if words[0] == "DETACH":
            name = nodes[-1].strip("`").lower()
            for t in [t for t in self.tables if t.startswith(name + "__")]:
                self.tables.pop(t)
                self.spark.catalog.dropTempView(t)
            self.attached.discard(name)
            return self.spark.range(0)
        if words[0] == "ANALYZE":
            named = [n.strip("`").lower() for n in nodes[1:]] or sorted(self.tables)
            return reduce(DataFrame.union, [self.tables[t].agg(F.lit(t).alias("tbl"), F.count("*").alias("stat")) for t in named], self.spark.createDataFrame([], "tbl string, stat long"))
        if words[0] == "PRAGMA" and words[1] == "TABLE_INFO":
            return tables.table_info(self.spark.table(nodes[2][1].strip("`'")))
        if words[0] == "PRAGMA" and words[1] in ("TABLE_LIST", "DATABASE_LIST"):
            rows = [(t, "view" if t in self.materialized else "table", len(df.columns)) for t, df in sorted(self.tables.items())]
            return self.spark.createDataFrame(rows, "name string, type string, ncol int") if words[1] == "TABLE_LIST" else self.spark.createDataFrame([(0, "main"), *enumerate(sorted(self.attached), 1)], "seq int, name string")
        return self.sql(text)

    # --- row changes -------------------------------------------------------------------

    def _delete(self, nodes: list, words: list[str]) -> DataFrame:
        name = nodes[2].strip("`").lower()
        where = F.expr(rewrite(_plain(nodes[4:])) if len(nodes) > 3 else "true")
        before = self.tables[name]
        self.table(name, changes.delete(before, where))
        return changes.deleted(before, where)

    def _update(self, nodes: list, words: list[str]) -> DataFrame:
        name, at = nodes[1].strip("`").lower(), words.index("WHERE") if "WHERE" in words else len(nodes)
        begin = words.index("SET") + 1
        source = words.index("FROM") if "FROM" in words[:at] else at
        sets = {part[0].strip("`"): rewrite(_plain(part[2:])) for part in split_by(nodes[begin:source])}
        before = self.tables[name]
        if source < at:
            # Rows get a number, written down so that it holds; of several matches of a row, one counts.
            numbered = staged(before.withColumn("_rid", F.monotonically_increasing_id()))
            numbered.createOrReplaceTempView(name)
            values = ", ".join(f"{e} AS _s{i}" for i, e in enumerate(sets.values()))
            where = f" WHERE {rewrite(_plain(nodes[at + 1 :]))}" if at < len(nodes) else ""
            found = self.spark.sql(f"SELECT {name}._rid AS _rid, {values} FROM {name}, {rewrite(_plain(nodes[source + 1 : at]))}{where}")
            found = staged(found.groupBy("_rid").agg(F.max(F.struct(*(f"_s{i}" for i in range(len(sets))))).alias("_new")))
            joined = numbered.join(found, "_rid", "left")
            place = {c: F.col(f"_new._s{i}") for i, c in enumerate(sets)}
            new = lambda df: df.select(*(F.when(F.col("_new").isNotNull(), place[c]).otherwise(F.col(c)).cast(before.schema[c].dataType).alias(c) if c in place else F.col(c) for c in before.columns))
            after, changed = new(joined), new(joined.where("_new IS NOT NULL"))
            before.createOrReplaceTempView(name)
        else:
            columns = {c: F.expr(e).cast(before.schema[c].dataType) for c, e in sets.items()}
            where = F.expr(rewrite(_plain(nodes[at + 1 :])) if at < len(nodes) else "true")
            after = changes.update(before, where, columns)
            changed = changes.update(changes.deleted(before, where), F.lit(True), columns)
        if name in self.schemas:
            self.schemas[name].test(after)
        self.table(name, after)
        return changed

    def _insert(self, nodes: list, words: list[str]) -> DataFrame:
        at = words.index("INTO")
        policy = "REPLACE" if words[0] == "REPLACE" else words[2] if words[1] == "OR" else ""
        name, rest = nodes[at + 1].strip("`").lower(), nodes[at + 2 :]
        before, schema = self.tables[name], self.schemas.get(name)
        columns = [c.strip("`") for c in rest.pop(0)[1:-1] if c != ","] if rest and isinstance(rest[0], list) else before.columns
        at = next((i for i, n in enumerate(rest[:-1]) if upper(n) == "ON" and upper(rest[i + 1]) == "CONFLICT"), len(rest))
        if [upper(n) for n in rest[:2]] == ["DEFAULT", "VALUES"]:
            columns, new = [], self.spark.range(1).select()
        elif upper(rest[0]) == "VALUES":
            # A column takes values of any class, each converted for itself.
            cell = lambda c, e: f"try_cast({rewrite(_plain(e))} AS {before.schema[c].dataType.simpleString()})"
            rows = [f"({', '.join(cell(c, e) for c, e in zip(columns, split_by(row[1:-1]), strict=True))})" for row in rest[1:at] if isinstance(row, list)]
            new = self.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)}").toDF(*columns)
        else:
            new = self.sql(_plain(rest[:at])).toDF(*columns)
        default = lambda c: F.expr(schema.defaults[c]) if schema and c in schema.defaults else F.lit(None)
        new = new.select(*((F.col(c) if c in columns else default(c)).try_cast(before.schema[c].dataType).alias(c) for c in before.columns))
        if at < len(rest):
            after = self._conflict(before, new, rest[at + 2 :])
        elif policy in ("IGNORE", "REPLACE"):
            new = new.where(schema.row_holds()) if schema and policy == "IGNORE" else new
            after, new = self._by_keys(before, new, schema.keys if schema else [], policy)
        else:
            after = before.union(new)
        if schema:
            schema.test(after)
        self.table(name, after)
        return new

    def _by_keys(self, before: DataFrame, new: DataFrame, keys: list[list[str]], policy: str) -> tuple[DataFrame, DataFrame]:
        """INSERT OR IGNORE keeps what is there, and of new rows of a key the first; OR REPLACE the last. Rows have the order they are given in."""
        if not keys:
            return before.union(new), new
        new = staged(new.withColumn("_order", F.monotonically_increasing_id()))
        for key in keys:
            first = Window.partitionBy(*key).orderBy("_order" if policy == "IGNORE" else F.desc("_order"))
            known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
            new = new.where(known).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").union(new.where(~known))
            if policy == "IGNORE":
                new = new.join(before.select(*key), key, "left_anti").select(*new.columns)
            else:
                before = before.join(new.select(*key), key, "left_anti").select(*before.columns)
        new = new.drop("_order")
        return before.union(new), new

    # --- schemas -------------------------------------------------------------------------

    def _create(self, nodes: list, words: list[str]) -> DataFrame:
        skip = 3 if words[2:5] == ["IF", "NOT", "EXISTS"] else 0
        if words[1] == "SEQUENCE":
            rest = nodes[2 + skip :]
            value = lambda word, default: next((int("".join(rest[i + 1 + (upper(rest[i + 1]) in ("WITH", "BY")) :][:2 if "-" in rest[i + 1 : i + 3] else 1])) for i in range(len(rest)) if upper(rest[i]) == word), default)
            self.sequences[rest[0].strip("`").lower()] = Sequence(value("START", 1), value("INCREMENT", 1))
            return self.spark.range(0)
        if words[1] == "DOMAIN":
            name, rest = nodes[2 + skip].strip("`").lower(), [n for n in nodes[3 + skip :] if upper(n) != "AS"]
            self.domains[name] = rest
            return self.spark.range(0)
        if "AS" in words:
            at = words.index("AS")
            name = nodes[at - 1].strip("`")
            df = self.sql(_plain(nodes[at + 1 :]))
            self.table(name, staged(df) if "TABLE" in words[:at] or "MATERIALIZED" in words[:at] else df)
            if "MATERIALIZED" in words[:at]:
                self.materialized[name.lower()] = _plain(nodes[at + 1 :])
            return df
        at = next(i for i, n in enumerate(nodes) if isinstance(n, list))
        name = nodes[at - 1].strip("`").lower()
        schema = Schema.parse(nodes[at][1:-1], self.domains)
        self.schemas[name] = schema
        return self.table(name, self.spark.createDataFrame([], T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k in schema.types.items()]))).tables[name]

    def _alter(self, nodes: list) -> DataFrame:
        name, df = nodes[2].strip("`").lower(), self.tables[nodes[2].strip("`").lower()]
        rest = [n for n in nodes[3:] if upper(n) != "COLUMN"]
        act, names = upper(rest[0]), [n.strip("`") for n in rest[1:] if isinstance(n, str)]
        if act == "RENAME" and upper(names[0]) == "TO":
            self.tables.pop(name)
            self.spark.catalog.dropTempView(name)
            if name in self.schemas:
                self.schemas[names[1].lower()] = self.schemas.pop(name)
            return self.table(names[1], df).tables[names[1].lower()]
        if act == "RENAME":
            df = df.withColumnRenamed(names[0], names[2])
        elif act == "DROP":
            df = df.drop(names[0])
        elif act == "ADD":
            df = df.withColumn(names[0], F.lit(None).cast(KINDS[types.affinity(" ".join(names[1:]))]))
        return self.table(name, df).tables[name]

    def _refresh(self) -> None:
        """Materialized views anew, in the order they were made."""
        for name, text in self.materialized.items():
            self.table(name, staged(self.sql(text)))

    def _attach(self, folder: str, name: str) -> DataFrame:
        """Each Parquet table of a folder as name.table."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        self.attached.add(name.lower())
        for f in found:
            if f.getPath().getName().endswith(".parquet"):
                self.table(f"{name.lower()}__{f.getPath().getName().removesuffix('.parquet')}", self.spark.read.parquet(f.getPath().toString()))
        return self.spark.range(0)

    def sql(self, text: str, **parameters) -> DataFrame:
        """Run one query; ``:name`` parameters take keyword values. WITH RECURSIVE ... UNION runs to its fixed point."""
        text = self._stated(text)
        if (parts := self._recursion(text)) is not None:
            tables_, rest = parts
            for name, columns, body in tables_:
                self._common_table(name, columns, body, parameters).createOrReplaceTempView(name)
            return self.sql(rest, **parameters)
        try:
            return self.spark.sql(rewrite(text, integers=self._integers(text)), args=parameters or None)
        except AnalysisException as e:
            if (e.getCondition() or "").split(".")[0] not in ("MISSING_AGGREGATION", "MISSING_GROUP_BY"):
                raise
            return self.spark.sql(rewrite(text, bare=True, integers=self._integers(text)), args=parameters or None)

    def _integers(self, text: str) -> frozenset[str]:
        """Columns that every table has as whole numbers, and that the text gives no other meaning."""
        if "/" not in text:
            return frozenset()
        kinds: dict[str, bool] = {}
        for df in self.tables.values():
            for f in df.schema.fields:
                kinds[f.name.lower()] = kinds.get(f.name.lower(), True) and isinstance(f.dataType, T.IntegralType)
        named = {n.lower() for n in re.findall(r"(?i)\bAS\s+[`\"]?(\w+)", text)}
        return frozenset(c for c, whole in kinds.items() if whole and c not in named)

    def _stated(self, text: str) -> str:
        """Attached tables under their names here, and sequences' values in their places (one for each call in the text)."""
        if not self.attached and not re.search(r"(?i)\b(nextval|currval|setval)\b", text):
            return text

        def walk(nodes: list) -> list:
            out: list = []
            for i, n in enumerate(nodes):
                if isinstance(n, list):
                    if out and upper(out[-1]) in ("NEXTVAL", "CURRVAL", "SETVAL"):
                        args = [a.strip("'") for a in n[1:-1] if a != ","]
                        out[-1] = str(self.sequences[args[0].lower()].call(upper(out[-1]), args[1:]))
                    else:
                        out.append(walk(n))
                elif out and n == "." and isinstance(out[-1], str) and out[-1].strip("`").lower() in self.attached and f"{out[-1].strip('`').lower()}__{nodes[i + 1].strip('`').lower()}" in self.tables:
                    out[-1] = out[-1].strip("`").lower() + "__"
                elif out and isinstance(out[-1], str) and out[-1].endswith("__") and nodes[i - 1] == ".":
                    out[-1] += n.strip("`")
                else:
                    out.append(n)
            return out

        return _plain(walk(nest(tokens(text))))

    def _common_table(self, name: str, columns: list[str], body: list, parameters: dict) -> DataFrame:
        """One table of WITH RECURSIVE: a fixed point if it is a distinct union over itself."""
        named = lambda df: df.toDF(*columns) if columns else df
        at = [i for i, n in enumerate(body) if upper(n) == "UNION"]
        if name.lower() not in {n.strip("`").lower() for n in flat(body)}:
            return named(self.sql(_plain(body), **parameters))
        if len(at) != 1 or upper(body[at[0] + 1]) == "ALL":
            head = f"{name} ({', '.join(columns)})" if columns else name
            return self.spark.sql(rewrite(f"WITH RECURSIVE {head} AS ({_plain(body)}) SELECT * FROM {name}"), args=parameters or None)
        step = _plain(body[at[0] + 1 :])
        return recursive_union(named(self.sql(_plain(body[: at[0]]), **parameters)), lambda new: self._step(new, name, step, parameters))

    def _step(self, new: DataFrame, name: str, step: str, parameters: dict) -> DataFrame:
        new.createOrReplaceTempView(name)
        return self.sql(step, **parameters)

    @staticmethod
    def _recursion(text: str) -> tuple[list[tuple[str, list[str], list]], str] | None:
        """The tables (name, columns, body) of WITH RECURSIVE and the query after them, if one of them is a distinct union over itself."""
        if not re.match(r"\s*WITH\s+RECURSIVE\b", text, re.I):
            return None
        nodes, found, k, distinct = nest(tokens(text)), [], 2, False
        while True:
            name, k = nodes[k], k + 1
            columns = [c.strip("`") for c in nodes[k][1:-1] if c != ","] if isinstance(nodes[k], list) else []
            k += bool(columns)
            while not isinstance(nodes[k], list):
                k += 1  # AS [NOT] [MATERIALIZED]
            body = nodes[k][1:-1]
            at = [i for i, n in enumerate(body) if upper(n) == "UNION"]
            distinct |= len(at) == 1 and upper(body[at[0] + 1]) != "ALL" and name.strip("`").lower() in {n.strip("`").lower() for n in flat(body)}
            found.append((name.strip("`"), columns, body))
            k += 1
            if k >= len(nodes) or nodes[k] != ",":
                return (found, _plain(nodes[k:])) if distinct else None
            k += 1

    @staticmethod
    def _conflict(before: DataFrame, new: DataFrame, clause: list) -> DataFrame:
        """ON CONFLICT (keys) DO NOTHING, or DO UPDATE SET columns to the new row's (``excluded``) or the old row's expressions."""
        key = [c.strip("`") for c in clause[0][1:-1] if c != ","]
        if upper(clause[2]) == "NOTHING":
            return changes.upsert(before, new, key, "nothing")
        sets = {part[0].strip("`"): rewrite(_plain(part[2:])) for part in split_by(clause[4:])}
        table, excluded = before.alias("old"), changes.upsert(before.limit(0), new, key).alias("excluded")
        same = [F.col(f"old.{k}") == F.col(f"excluded.{k}") for k in key]
        joined = table.join(excluded, same, "left")
        hit = F.col(f"excluded.{key[0]}").isNotNull()
        plain = lambda e: re.sub(r"(?<![.\w`])(" + "|".join(map(re.escape, before.columns)) + r")\b(?!\s*[.(])", r"old.\1", re.sub(r"\s*\.\s*", ".", e))
        updated = joined.select(*((F.when(hit, F.expr(plain(sets[c])).cast(before.schema[c].dataType)).otherwise(F.col(f"old.{c}")) if c in sets else F.col(f"old.{c}")).alias(c) for c in before.columns))
        return updated.union(new.join(before.select(*key), key, "left_anti").select(*before.columns))

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan of a query as text."""
        import contextlib
        import io

        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            self.sql(text).explain(mode)
        return out.getvalue()


def _plain(nodes: list) -> str:
    """Tokens as dialect text again: their literals carry Spark's escapes."""
    return re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: "'" + m[1].replace("\\'", "''").replace("\\\\", "\\") + "'", show(nodes))
