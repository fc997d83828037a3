"""Functions that Catalyst cannot express, as Arrow-batched UDFs under the prefix ``bs_``."""

from __future__ import annotations

import base64
import ipaddress
import json
import math
import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jsontext as jt
from .blake3 import blake3
from .fuzzy import FUZZY
from .macros import macro, text, unquoted
from .printf import printf

REGISTERED: dict[str, tuple[Callable, T.DataType]] = {}


def udf(name: str, returns: T.DataType) -> Callable:
    def add(f: Callable) -> Callable:
        REGISTERED[f"bs_{name}"] = (f, returns)
        return f

    return add


def arrow_udf(f: Callable, returns: T.DataType) -> Callable:
    """A pandas UDF that applies f to each row's values; NULL and NaN arrive as None."""

    def apply(*columns: pd.Series) -> pd.Series:
        rows = zip(*([None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in c] for c in columns), strict=True)
        return pd.Series([f(*row) for row in rows], dtype=object)

    def one(a: pd.Series) -> pd.Series:
        return apply(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return apply(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return apply(a, b, c)

    n = f.__code__.co_argcount
    return F.pandas_udf((one, two, three)[n - 1], returns)


def register(spark: SparkSession) -> None:
    """Make all UDFs known to the session's SQL."""
    for name, (f, returns) in REGISTERED.items():
        spark.udf.register(name, arrow_udf(f, returns))


def arguments(*xs: str) -> str:
    """Values of any type as JSON texts in an array: NULL, numbers and texts keep apart."""
    one = lambda x: f"CASE WHEN {x} IS NULL THEN 'null' WHEN typeof({x}) IN ('string', 'binary', 'timestamp', 'date') THEN to_json(named_struct('v', {text(x)})) ELSE {text(x)} END"
    return f"array({', '.join(map(one, xs))})" if xs else "CAST(array() AS ARRAY<STRING>)"


def values(args: list[str]) -> list:
    out = []
    for a in args:
        if a.startswith('{"v":'):
            out.append(json.loads(a)["v"])
        elif a in ("true", "false"):
            out.append(int(a == "true"))
        elif a == "null":
            out.append(None)
        else:
            out.append(jt.Number(a))
    return out


# --- JSON ------------------------------------------------------------------------

macro("json", "jsonb")(lambda x: f"bs_json({text(x)})")
macro("json_error_position")(lambda x: f"bs_json_error_position({text(x)})")
macro("json_valid")(lambda x, flags="1": f"CASE WHEN {x} IS NOT NULL THEN CAST(bs_json_error_position({text(x)}) = 0 AS INT) END")
macro("json_pretty")(lambda x, indent="'    '": f"bs_json_pretty({text(x)}, {text(indent)})")
macro("json_patch", "jsonb_patch")(lambda a, b: f"bs_json_patch({text(a)}, {text(b)})")
macro("json_type")(lambda x, path="'$'": f"bs_json_type({text(x)}, {text(path)})")
macro("json_array_length")(lambda x, path="'$'": f"bs_json_array_length({text(x)}, {text(path)})")
macro("json_arrow")(lambda x, path: f"bs_json_arrow({text(x)}, {text(path)})")
macro("json_extract", "jsonb_extract")(lambda x, *paths: f"bs_json_extract({text(x)}, array({', '.join(map(text, paths))}))")
macro("json_arrow_text")(lambda x, path: f"bs_json_arrow_text({text(x)}, {text(path)})")
macro("json_array", "jsonb_array")(lambda *xs: f"bs_json_array({arguments(*xs)})")
macro("json_object", "jsonb_object")(lambda *xs: f"bs_json_object({arguments(*xs)})")
macro("json_quote")(lambda x: f"bs_json_quote({arguments(x)})")
macro("json_remove", "jsonb_remove")(lambda x, *paths: f"bs_json_remove({text(x)}, array({', '.join(map(text, paths))}))")
for _name in ("insert", "replace", "set"):
    macro(f"json_{_name}", f"jsonb_{_name}")(lambda x, *rest, n=_name: f"bs_json_{n}({text(x)}, {arguments(*rest)})")

S, I, L, B = T.StringType(), T.IntegerType(), T.LongType(), T.BinaryType()
udf("json", S)(lambda x: None if x is None else jt.dump(jt.parse(x)))
udf("json_error_position", I)(lambda x: None if x is None else jt.error_position(x))
udf("json_pretty", S)(lambda x, indent: None if x is None else jt.pretty(jt.parse(x), indent or ""))
udf("json_patch", S)(lambda a, b: None if a is None or b is None else jt.dump(jt.patch(jt.parse(a), jt.parse(b))))
udf("json_array", S)(lambda args: jt.dump([jt.value(v) for v in values(args)]))
udf("json_quote", S)(lambda args: jt.dump(jt.value(values(args)[0])))
udf("json_type", S)(lambda x, p: None if x is None else jt.kind(jt.find(jt.parse(x), p)))
udf("json_remove", S)(lambda x, paths: None if x is None else jt.dump(jt.remove(jt.parse(x), list(paths))))


@udf("json_array_length", L)
def json_array_length(x, path):
    found = None if x is None else jt.find(jt.parse(x), path)
    return len(found) if isinstance(found, list) else None if found is jt.MISSING or x is None else 0


@udf("json_arrow", S)
def json_arrow(x, path):
    """The value at a path, key or index, as JSON."""
    found = jt.MISSING if x is None or path is None else jt.find(jt.parse(x), jt.short_path(path))
    return None if found is jt.MISSING else jt.dump(found)


@udf("json_arrow_text", S)
def json_arrow_text(x, path):
    found = jt.MISSING if x is None or path is None else jt.find(jt.parse(x), jt.short_path(path))
    return jt.plain(found)


@udf("json_extract", S)
def json_extract(x, paths):
    """One path: the value as text; several: a JSON array."""
    if x is None:
        return None
    doc = jt.parse(x)
    found = [jt.find(doc, p) for p in paths]
    return jt.plain(found[0]) if len(found) == 1 else jt.dump([None if f is jt.MISSING else f for f in found])


@udf("json_object", S)
def json_object(args):
    v = values(args)
    return jt.dump(jt.Pairs([(jt.plain(k), jt.value(x)) for k, x in zip(v[::2], v[1::2], strict=True)]))


def editor(mode: str) -> Callable:
    def edit(x, args):
        if x is None:
            return None
        v = values(args)
        doc = jt.parse(x)
        for path, new in zip(v[::2], v[1::2], strict=True):
            doc = jt.put(doc, path, jt.value(new), mode)
        return jt.dump(doc)

    return edit


for _mode in ("insert", "replace", "set"):
    udf(f"json_{_mode}", S)(editor(_mode))

# --- text ------------------------------------------------------------------------

macro("printf", "format")(lambda fmt, *xs: f"bs_printf({text(fmt)}, {arguments(*xs)})")
macro("unistr")(lambda x: f"bs_unistr({text(x)})")
macro("unistr_quote")(lambda x: f"bs_unistr_quote({text(x)})")
udf("printf", S)(lambda fmt, args: None if fmt is None else printf(fmt, [float(v) if isinstance(v, jt.Number) and not v.whole else int(v) if isinstance(v, jt.Number) else v for v in values(args)]))


@udf("unistr", S)
def unistr(x):
    r"""Decode \XXXX, \uXXXX, \+XXXXXX, \UXXXXXXXX and \\."""
    if x is None:
        return None
    take = lambda m: "\\" if m[0] == "\\\\" else chr(int(next(g for g in m.groups() if g), 16))
    return re.sub(r"\\\\|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\\+([0-9A-Fa-f]{6})|\\([0-9A-Fa-f]{4})", take, x)


@udf("unistr_quote", S)
def unistr_quote(x):
    if x is None:
        return "NULL"
    body = x.replace("'", "''")
    if any(ord(c) < 32 for c in x):
        body = "".join(f"\\u{ord(c):04x}" if ord(c) < 32 else "\\\\" if c == "\\" else c for c in body)
        return f"unistr('{body}')"
    return f"'{body}'"


# --- bytes and addresses ------------------------------------------------------------

macro("randomblob")(lambda n: f"bs_randomblob({n})")
udf("randomblob", B)(lambda n: os.urandom(max(int(n or 1), 1)))


@macro("crypto_encode")
def crypto_encode(x: str, form: str) -> str:
    kind = (unquoted(form) or "").lower()
    native = {"base64": f"base64({x})", "hex": f"lower(hex({x}))", "url": f"replace(url_encode({text(x)}), '+', '%20')"}
    return native.get(kind) or f"bs_encode(CAST({x} AS BINARY), '{kind}')"


@macro("crypto_decode")
def crypto_decode(x: str, form: str) -> str:
    kind = (unquoted(form) or "").lower()
    native = {"base64": f"unbase64({x})", "hex": f"unhex({x})", "url": f"CAST(url_decode({x}) AS BINARY)"}
    return native.get(kind) or f"bs_decode({text(x)}, '{kind}')"


@udf("encode", S)
def encode(x, kind):
    f = {"base32": base64.b32encode, "base85": base64.a85encode}.get(kind)
    return None if x is None or f is None else f(x).decode()


@udf("decode", B)
def decode(x, kind):
    f = {"base32": base64.b32decode, "base85": base64.a85decode}.get(kind)
    return None if x is None or f is None else f(x.encode())


def network(x):
    try:
        return ipaddress.ip_interface(x)
    except ValueError:
        return None


for _name in ("ipfamily", "iphost", "ipmasklen", "ipnetwork"):
    macro(_name)(lambda x, n=_name: f"bs_{n}({text(x)})")
macro("ipcontains")(lambda net, x: f"bs_ipcontains({text(net)}, {text(x)})")
udf("ipfamily", I)(lambda x: (n := network(x)) and n.version)
udf("iphost", S)(lambda x: (n := network(x)) and str(n.ip))
udf("ipmasklen", I)(lambda x: None if (n := network(x)) is None else n.network.prefixlen)
udf("ipnetwork", S)(lambda x: (n := network(x)) and str(n.network))


@udf("ipcontains", I)
def ipcontains(net, x):
    a, b = network(net), network(x)
    return None if a is None or b is None else int(a.version == b.version and b.ip in a.network)


macro("crypto_blake3")(lambda x: f"bs_blake3(CAST({x} AS BINARY))")
udf("blake3", B)(lambda x: None if x is None else blake3(x))
macro("quote_literal")(lambda x: f"concat('\\'', replace({text(x)}, '\\'', '\\'\\''), '\\'')")


@macro("pg_input_is_valid")
def pg_input_is_valid(x: str, kind: str) -> str:
    names = {"integer": "INT", "int": "INT", "bigint": "BIGINT", "smallint": "SMALLINT", "real": "FLOAT", "double precision": "DOUBLE", "numeric": "DECIMAL(38, 10)", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "text": "STRING"}
    return f"try_cast({text(x)} AS {names[(unquoted(kind) or '').lower()]}) IS NOT NULL"


#: Format words of to_char by the pattern letters that print them, longest first.
CHAR_WORDS = {"YYYY": "yyyy", "MONTH": "MMMM", "HH24": "HH", "HH12": "hh", "MON": "MMM", "DDD": "DDD", "DAY": "EEEE", "MM": "MM", "DD": "dd", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a"}


@macro("to_char")
def to_char(x: str, form: str) -> str:
    """Timestamps by format words; numbers by Spark's own number formats."""
    pattern = unquoted(form) or ""
    if not re.search("YYYY|MM|DD|HH|MI|SS", pattern):
        return f"to_char(CAST({x} AS DECIMAL(38, 10)), {form})"
    done = re.sub("|".join(CHAR_WORDS), lambda m: CHAR_WORDS[m[0]], pattern)
    return f"date_format(CAST({x} AS TIMESTAMP), '{done}')"


# --- fuzzy matching ----------------------------------------------------------------

macro("fuzzy_leven")(lambda a, b: f"levenshtein({text(a)}, {text(b)})")
for _name, (_f, _kind) in FUZZY.items():
    udf(_name, {"int": I, "real": T.DoubleType(), "text": S}[_kind])(_f)
    macro(_name)(lambda *xs, n=_name: f"bs_{n}({', '.join(map(text, xs))})")
