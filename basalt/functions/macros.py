"""Scalar functions as Spark SQL text, so that Catalyst sees only its own expressions.

A macro takes SQL text for each argument and returns SQL text. ``call`` turns
one into a Column; the dialect expands them in whole queries.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MACROS: dict[str, Callable[..., str]] = {}


def macro(*names: str) -> Callable:
    def add(f: Callable[..., str]) -> Callable[..., str]:
        for name in names or (f.__name__.rstrip("_"),):
            MACROS[name] = f
        return f

    return add


def expand(name: str, *args: str) -> str:
    f = MACROS[name.lower()]
    try:
        inspect.signature(f).bind(*args)
    except TypeError:
        raise ValueError(f"wrong number of arguments to {name}()") from None
    return f"({f(*map(closed, args))})"


def closed(x: str) -> str:
    """In brackets, unless it is a name, a number or a literal."""
    return x if re.fullmatch(r"\s*(-?[\w.`]+|'(?:[^'\\]|\\.|'')*')\s*", x) else f"({x})"


def call(name: str, *args: str) -> Column:
    """The function over SQL expressions given as text, such as column names or literals."""
    return F.expr(expand(name, *args))


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def real(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def whole(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def no_nan(x: str) -> str:
    """NaN is no value: it becomes NULL."""
    return f"nullif({x}, double('NaN'))"


# --- casts ---------------------------------------------------------------------


@macro("cast_integer")
def cast_integer(x: str) -> str:
    """The longest integer prefix of a text, a real cut toward zero; 0 where there is none."""
    prefix = f"try_cast(trim(regexp_extract({text(x)}, r'^\\s*[+-]?\\d+', 0)) AS BIGINT)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN typeof({x}) = 'string' THEN coalesce({prefix}, 0) ELSE coalesce(try_cast({x} AS BIGINT), 0) END"


@macro("cast_real")
def cast_real(x: str) -> str:
    prefix = f"try_cast(trim(regexp_extract({text(x)}, r'^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?', 0)) AS DOUBLE)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN typeof({x}) = 'string' THEN coalesce({prefix}, 0.0D) ELSE try_cast({x} AS DOUBLE) END"


@macro("cast_text")
def cast_text(x: str) -> str:
    return text(x)


@macro("cast_numeric")
def cast_numeric(x: str) -> str:
    return cast_real(x)


# --- arithmetic ----------------------------------------------------------------


@macro("int_div")
def int_div(a: str, b: str) -> str:
    """Division of integers: cut toward zero, NULL by zero."""
    return f"CASE WHEN {whole(b)} = 0 THEN NULL ELSE {whole(a)} div {whole(b)} END"


@macro("divide")
def divide(a: str, b: str) -> str:
    """Division by the operands' types: integers are cut toward zero, and NULL stands for x / 0."""
    ints = "('tinyint', 'smallint', 'int', 'bigint')"
    return f"CASE WHEN typeof({a}) IN {ints} AND typeof({b}) IN {ints} THEN CAST({int_div(a, b)} AS DOUBLE) ELSE try_divide({real(a)}, {real(b)}) END"


@macro("int_mod")
def int_mod(a: str, b: str) -> str:
    return f"try_mod({whole(a)}, {whole(b)})"


@macro("add_promote")
def add_promote(a: str, b: str) -> str:
    """Integer addition that becomes real where 64 bits do not hold it."""
    return f"coalesce(CAST(try_add({whole(a)}, {whole(b)}) AS DOUBLE), {real(a)} + {real(b)})"


@macro("mul_promote")
def mul_promote(a: str, b: str) -> str:
    return f"coalesce(CAST(try_multiply({whole(a)}, {whole(b)}) AS DOUBLE), {real(a)} * {real(b)})"


@macro("shift_left")
def shift_left(a: str, n: str) -> str:
    """Shifts by 64 or more give 0 (-1 to the right of a negative); negative counts shift the other way."""
    left = f"CASE WHEN abs({whole(n)}) >= 64 THEN 0L ELSE shiftleft({whole(a)}, CAST(abs({n}) AS INT)) END"
    right = f"CASE WHEN abs({whole(n)}) >= 64 THEN IF({whole(a)} < 0, -1L, 0L) ELSE shiftright({whole(a)}, CAST(abs({n}) AS INT)) END"
    return f"CASE WHEN {n} >= 0 THEN {left} ELSE {right} END"


@macro("shift_right")
def shift_right(a: str, n: str) -> str:
    return shift_left(a, f"(-({n}))")


@macro("truth")
def truth(x: str) -> str:
    """A number as a condition: true if not zero."""
    return f"CASE WHEN typeof({x}) = 'boolean' THEN try_cast({x} AS BOOLEAN) ELSE {cast_real(x)} <> 0 END"


@macro("is_true")
def is_true(x: str) -> str:
    return f"CAST(coalesce({truth(x)}, false) AS INT)"


@macro("is_false")
def is_false(x: str) -> str:
    return f"CAST(coalesce(NOT ({truth(x)}), false) AS INT)"


# --- text ----------------------------------------------------------------------

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
LOWER = "'abcdefghijklmnopqrstuvwxyz'"


@macro("char", "chr")
def char(*codes: str) -> str:
    """Code points as text: UTF-16 units, encoded and decoded, so that all planes work."""
    if not codes:
        return "''"
    unit = lambda h: f"lpad(hex({h}), 4, '0')"
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '' WHEN {c} < 65536 THEN {unit(whole(c))} ELSE concat({unit(f'55296 + (({whole(c)} - 65536) div 1024)')}, {unit(f'56320 + ({whole(c)} - 65536) % 1024')}) END"
    return f"decode(unhex(concat({', '.join(map(one, codes))})), 'UTF-16BE')"


@macro("concat")
def concat(*xs: str) -> str:
    return f"concat_ws('', {', '.join(map(text, xs))})"


@macro("concat_ws")
def concat_ws(sep: str, *xs: str) -> str:
    return f"concat_ws({text(sep)}, {', '.join(map(text, xs))})"


def glob_regex(pattern: str) -> str:
    """A GLOB pattern as an anchored regular expression."""
    out, i = ["^"], 0
    while i < len(pattern):
        c = pattern[i]
        end = -1
        if c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))
        if c == "*":
            out.append("[\\s\\S]*")
        elif c == "?":
            out.append("[\\s\\S]")
        elif end > 0:
            body = pattern[i + 1 : end]
            not_, body = ("^", body[1:]) if body[0] == "^" else ("", body)
            out.append(f"[{not_}" + "".join("\\" + x if x in "\\[]&^" else x for x in body) + "]")
            i = end
        elif c == "[":
            return "(?!)"  # a class without an end matches nothing
        else:
            out.append("\\" + c if c in "\\^$.|+(){}]" else c)
        i += 1
    return "".join(out) + "$"


def unquoted(sql: str) -> str | None:
    """The value of a text literal, or None."""
    s = sql.strip()
    if len(s) >= 2 and s[0] == s[-1] == "'":
        return s[1:-1].replace("\\'", "'").replace("\\\\", "\\").replace("''", "'")
    return None


@macro("glob")
def glob(pattern: str, x: str) -> str:
    """Case-sensitive: ``*``, ``?`` and ``[classes]``; the pattern is a literal or an expression without classes."""
    value = unquoted(pattern)
    if value is not None:
        return f"CAST({text(x)} RLIKE {literal(glob_regex(value))} AS INT)"
    escaped = f"regexp_replace({text(pattern)}, r'([\\\\^$.|+(){{}}\\]])', r'\\\\$1')"
    return f"CAST(regexp_like({text(x)}, concat('^', replace(replace({escaped}, '*', r'[\\s\\S]*'), '?', r'[\\s\\S]'), '$')) AS INT)"


@macro("like")
def like(pattern: str, x: str, escape: str | None = None) -> str:
    """LIKE without regard to ASCII case."""
    fold = lambda v: f"translate({text(v)}, {UPPER}, {LOWER})"
    value = unquoted(escape) if escape else None
    if value is not None:
        return f"CAST({fold(x)} LIKE {fold(pattern)} ESCAPE {literal(value)} AS INT)"
    return f"CAST({fold(x)} LIKE replace({fold(pattern)}, r'\\', r'\\\\') AS INT)"


@macro("instr", "strpos")
def instr(x: str, y: str) -> str:
    return f"instr({text(x)}, {text(y)})"


@macro("length", "char_length", "character_length")
def length(x: str) -> str:
    return f"CASE WHEN typeof({x}) = 'binary' THEN octet_length({x}) ELSE char_length({text(x)}) END"


@macro("octet_length")
def octet_length(x: str) -> str:
    return f"octet_length({text(x)})"


@macro("upper")
def upper(x: str) -> str:
    return f"translate({text(x)}, {LOWER}, {UPPER})"


@macro("lower")
def lower(x: str) -> str:
    return f"translate({text(x)}, {UPPER}, {LOWER})"


def trimming(side: str) -> Callable[..., str]:
    def f(x: str, chars: str = "' '") -> str:
        return f"trim({side} {text(chars)} FROM {text(x)})"

    return f


macro("trim", "btrim")(trimming("BOTH"))
macro("ltrim")(trimming("LEADING"))
macro("rtrim")(trimming("TRAILING"))


@macro("replace")
def replace(x: str, y: str, z: str) -> str:
    return f"replace({text(x)}, {text(y)}, {text(z)})"


@macro("substr", "substring")
def substr(x: str, i: str, n: str | None = None) -> str:
    """1-based; a negative start counts from the end; a start of 0 or before the text uses up characters; a negative count looks left."""
    s, size = text(x), f"char_length({text(x)})"
    first = f"CASE WHEN {i} < 0 THEN {size} + {i} + 1 ELSE CAST({i} AS INT) END"
    if n is None:
        return f"substr({s}, CAST(greatest({first}, 1) AS INT))"
    low = f"CASE WHEN {n} < 0 THEN ({first}) + ({n}) ELSE ({first}) END"
    high = f"CASE WHEN {n} < 0 THEN ({first}) ELSE ({first}) + ({n}) END"  # exclusive
    return f"CASE WHEN {n} IS NULL THEN NULL ELSE substr({s}, CAST(greatest({low}, 1) AS INT), CAST(greatest(({high}) - greatest({low}, 1), 0) AS INT)) END"


@macro("unicode")
def unicode_(x: str) -> str:
    return f"CASE WHEN {text(x)} = '' THEN NULL ELSE ascii({text(x)}) END"


@macro("quote")
def quote(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'NULL' WHEN typeof({x}) = 'binary' THEN concat('X\\'', hex({x}), '\\'') WHEN typeof({x}) = 'string' THEN concat('\\'', replace({text(x)}, '\\'', '\\'\\''), '\\'') ELSE {text(x)} END"


@macro("hex")
def hex_(x: str) -> str:
    """Of the value as text (bytes as they are)."""
    return f"CASE WHEN typeof({x}) = 'binary' THEN hex({x}) ELSE hex({text(x)}) END"


@macro("unhex")
def unhex(x: str, ignore: str = "''") -> str:
    clean = f"translate({text(x)}, {text(ignore)}, '')"
    return f"CASE WHEN {clean} RLIKE '^([0-9A-Fa-f]{{2}})*$' THEN unhex({clean}) END"


@macro("get_byte")
def get_byte(b: str, i: str) -> str:
    return f"CAST(conv(hex(substr({b}, CAST({i} AS INT) + 1, 1)), 16, 10) AS INT)"


@macro("set_byte")
def set_byte(b: str, i: str, v: str) -> str:
    h = f"hex({b})"
    return f"unhex(concat(substr({h}, 1, CAST(2 * {i} AS INT)), lpad(hex({v}), 2, '0'), substr({h}, CAST(2 * {i} + 3 AS INT))))"


@macro("zeroblob")
def zeroblob(n: str) -> str:
    return f"unhex(repeat('00', CAST(greatest({n}, 0) AS INT)))"


@macro("soundex", "fuzzy_soundex")
def soundex(x: str) -> str:
    """``?000`` without a letter."""
    return f"CASE WHEN {text(x)} IS NULL OR NOT {text(x)} RLIKE '[A-Za-z]' THEN '?000' ELSE soundex(regexp_replace({text(x)}, '^[^A-Za-z]+', '')) END"


@macro("string_reverse", "reverse")
def string_reverse(x: str) -> str:
    return f"reverse({text(x)})"


@macro("repeat")
def repeat(x: str, n: str) -> str:
    return f"repeat({text(x)}, CAST({n} AS INT))"


@macro("lpad")
def lpad(x: str, n: str, fill: str = "' '") -> str:
    return f"lpad({text(x)}, CAST({n} AS INT), {text(fill)})"


@macro("rpad")
def rpad(x: str, n: str, fill: str = "' '") -> str:
    return f"rpad({text(x)}, CAST({n} AS INT), {text(fill)})"


@macro("regexp", "regexp_like_ext")
def regexp(pattern: str, x: str) -> str:
    return f"CAST(regexp_like({text(x)}, {pattern}) AS INT)"


@macro("regexp_substr")
def regexp_substr(x: str, pattern: str) -> str:
    return f"regexp_substr({text(x)}, {pattern})"


@macro("regexp_capture")
def regexp_capture(x: str, pattern: str, n: str = "1") -> str:
    return f"CASE WHEN regexp_like({text(x)}, {pattern}) THEN regexp_extract({text(x)}, {pattern}, CAST({n} AS INT)) END"


@macro("regexp_replace")
def regexp_replace(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({text(x)}, {pattern}, {by})"


# --- conditions and types ------------------------------------------------------


@macro("ifnull")
def ifnull(x: str, y: str) -> str:
    return f"coalesce({x}, {y})"


@macro("iif", "if")
def iif(c: str, a: str, b: str = "NULL") -> str:
    return f"CASE WHEN {truth(c)} THEN {a} ELSE {b} END"


@macro("typeof")
def typeof(x: str) -> str:
    t = f"typeof({x})"
    return (
        f"CASE WHEN {x} IS NULL THEN 'null' WHEN {t} IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' "
        f"WHEN {t} IN ('float', 'double') OR {t} LIKE 'decimal%' THEN 'real' WHEN {t} = 'binary' THEN 'blob' ELSE 'text' END"
    )


@macro("likely", "unlikely")
def likely(x: str) -> str:
    return x


@macro("likelihood")
def likelihood(x: str, p: str) -> str:
    return x


@macro("random")
def random_() -> str:
    return "xxhash64(uuid())"


@macro("scalar_max")
def scalar_max(*xs: str) -> str:
    """The largest argument, NULL if any is NULL."""
    return f"CASE WHEN {' OR '.join(f'{x} IS NULL' for x in xs)} THEN NULL ELSE greatest({', '.join(xs)}) END"


@macro("scalar_min")
def scalar_min(*xs: str) -> str:
    return f"CASE WHEN {' OR '.join(f'{x} IS NULL' for x in xs)} THEN NULL ELSE least({', '.join(xs)}) END"


@macro("boolean_to_int")
def boolean_to_int(x: str) -> str:
    return f"CAST({x} AS INT)"


@macro("int_to_boolean")
def int_to_boolean(x: str) -> str:
    return f"{x} <> 0"


@macro("numeric_encode")
def numeric_encode(x: str, precision: str, scale: str) -> str:
    return f"CAST({x} AS DECIMAL({precision.strip()}, {scale.strip()}))"


@macro("numeric_decode")
def numeric_decode(x: str) -> str:
    return text(x)


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("lt", "<"), ("eq", "=")):
    macro(f"numeric_{_name}")(lambda a, b, op=_op: f"CAST({a} AS DECIMAL(28, 8)) {op} CAST({b} AS DECIMAL(28, 8))")


@macro("numeric_div")
def numeric_div(a: str, b: str) -> str:
    return f"try_divide(CAST({a} AS DECIMAL(28, 8)), CAST({b} AS DECIMAL(28, 8)))"


# --- mathematics ---------------------------------------------------------------

for _name in ("asinh", "atan", "cos", "cosh", "sin", "sinh", "tan", "tanh", "degrees", "radians", "exp", "log2"):
    macro(_name)(lambda x, f=_name: f"{f}({real(x)})")
for _name in ("acos", "acosh", "asin", "atanh"):
    macro(_name)(lambda x, f=_name: no_nan(f"{f}({real(x)})"))


@macro("atan2")
def atan2(y: str, x: str) -> str:
    return f"atan2({real(y)}, {real(x)})"


@macro("pi")
def pi() -> str:
    return "pi()"


@macro("ln")
def ln(x: str) -> str:
    return f"CASE WHEN {real(x)} > 0 THEN ln({real(x)}) END"


@macro("log10")
def log10(x: str) -> str:
    return f"CASE WHEN {real(x)} > 0 THEN log10({real(x)}) END"


@macro("log")
def log(a: str, x: str | None = None) -> str:
    """Base 10 for one argument, else base first."""
    if x is None:
        return log10(a)
    return f"CASE WHEN {real(a)} > 0 AND {real(a)} <> 1 AND {real(x)} > 0 THEN ln({real(x)}) / ln({real(a)}) END"


@macro("ceil", "ceiling")
def ceil(x: str) -> str:
    return f"ceil({real(x)})"


@macro("floor")
def floor(x: str) -> str:
    return f"floor({real(x)})"


@macro("trunc")
def trunc(x: str) -> str:
    return f"CASE WHEN {real(x)} < 0 THEN ceil({real(x)}) ELSE floor({real(x)}) END"


@macro("mod")
def mod(a: str, b: str) -> str:
    return f"try_mod({real(a)}, {real(b)})"


@macro("pow", "power")
def pow_(a: str, b: str) -> str:
    return f"pow({real(a)}, {real(b)})"


@macro("sqrt")
def sqrt(x: str) -> str:
    return f"CASE WHEN {real(x)} >= 0 THEN sqrt({real(x)}) END"


@macro("round")
def round_(x: str, n: str = "0") -> str:
    """Half away from zero, a real; negative digits count as 0."""
    value = unquoted(n) or n
    try:
        return f"round({real(x)}, {max(int(value), 0)})"
    except ValueError:
        return f"round({real(x)} * pow(10, greatest({n}, 0))) / pow(10, greatest({n}, 0))"


@macro("sign")
def sign(x: str) -> str:
    return f"CAST(signum(try_cast({x} AS DOUBLE)) AS INT)"


GCD_STEPS = 93  # the most that Euclid's steps on 64-bit integers can be


@macro("gcd")
def gcd(a: str, b: str) -> str:
    """Euclid's steps as a fold that stays still once it has ended."""
    start = f"named_struct('a', abs({whole(a)}), 'b', abs({whole(b)}))"
    return f"aggregate(sequence(1, {GCD_STEPS}), {start}, (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a)"


@macro("lcm")
def lcm(a: str, b: str) -> str:
    return f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0L ELSE abs({whole(a)} div ({gcd(a, b)}) * {whole(b)}) END"


# --- arrays, zero-based --------------------------------------------------------


@macro("array")
def array(*xs: str) -> str:
    return f"array({', '.join(xs)})"


@macro("array_element")
def array_element(a: str, i: str) -> str:
    return f"get({a}, CAST({i} AS INT))"


@macro("array_set_element")
def array_set_element(a: str, i: str, v: str) -> str:
    return f"transform({a}, (x, k) -> IF(k = {i}, {v}, x))"


@macro("array_length", "array_upper")
def array_length(a: str, dim: str = "1") -> str:
    return f"CASE WHEN {a} IS NULL THEN NULL ELSE size({a}) END"


@macro("array_append")
def array_append(a: str, x: str) -> str:
    return f"CASE WHEN {a} IS NULL THEN array({x}) ELSE array_append({a}, {x}) END"


@macro("array_prepend")
def array_prepend(x: str, a: str) -> str:
    return f"CASE WHEN {a} IS NULL THEN array({x}) ELSE array_prepend({a}, {x}) END"


@macro("array_cat")
def array_cat(a: str, b: str) -> str:
    return f"coalesce(concat({a}, {b}), {a}, {b})"


@macro("array_remove")
def array_remove(a: str, x: str) -> str:
    return f"filter({a}, v -> NOT v <=> {x})"


@macro("array_contains")
def array_contains(a: str, x: str) -> str:
    return f"CAST(exists({a}, v -> v <=> {x}) AS INT)"


@macro("array_position")
def array_position(a: str, x: str) -> str:
    return f"nullif(array_position({a}, {x}), 0) - 1"


@macro("array_slice")
def array_slice(a: str, s: str, e: str) -> str:
    return f"slice({a}, CAST(greatest({s}, 0) AS INT) + 1, CAST(greatest(least({e}, size({a})) - greatest({s}, 0), 0) AS INT))"


@macro("string_to_array")
def string_to_array(s: str, d: str, null: str = "NULL") -> str:
    """No delimiter: characters. An empty text: no elements."""
    if d.strip().upper() == "NULL":
        parts = f"split({text(s)}, '')"
    else:
        parts = f"CASE WHEN {text(d)} = '' THEN array({text(s)}) ELSE split({text(s)}, concat(r'\\Q', {text(d)}, r'\\E')) END"
    return f"CASE WHEN {text(s)} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE transform({parts}, v -> nullif(v, {text(null)})) END"


@macro("array_to_string")
def array_to_string(a: str, d: str, null: str | None = None) -> str:
    words = f"transform({a}, v -> {text('v')})"
    return f"array_join({words}, {d})" if null is None else f"array_join({words}, {d}, {null})"


@macro("array_overlap", "array_overlaps")
def array_overlap(a: str, b: str) -> str:
    return f"CAST(exists({a}, x -> exists({b}, y -> x = y)) AS INT)"


@macro("array_contains_all")
def array_contains_all(a: str, b: str) -> str:
    return f"CAST(size(array_except({b}, {a})) = 0 AS INT)"


# --- structs and unions --------------------------------------------------------


@macro("struct_pack")
def struct_pack(*pairs: str) -> str:
    return f"named_struct({', '.join(pairs)})"


@macro("struct_extract")
def struct_extract(s: str, field: str) -> str:
    return f"({s}).{unquoted(field) or field}"


@macro("union_value")
def union_value(tag: str, v: str) -> str:
    return f"named_struct('tag', {tag}, {tag}, {v})"


@macro("union_tag")
def union_tag(u: str) -> str:
    return f"({u}).tag"


@macro("union_extract")
def union_extract(u: str, tag: str) -> str:
    return f"CASE WHEN ({u}).tag = {tag} THEN ({u}).{unquoted(tag) or tag} END"


# --- vectors -------------------------------------------------------------------


@macro("vector", "vector32")
def vector32(j: str) -> str:
    return f"from_json({text(j)}, 'array<float>')"


@macro("vector64")
def vector64(j: str) -> str:
    return f"from_json({text(j)}, 'array<double>')"


@macro("vector32_sparse")
def vector32_sparse(j: str) -> str:
    """Dimensions, and the indices and values that are not zero."""
    v = vector32(j)
    at = f"filter(sequence(0, size({v}) - 1), i -> get({v}, i) <> 0)"
    return f"named_struct('dims', size({v}), 'idx', {at}, 'val', transform({at}, i -> get({v}, i)))"


@macro("vector8")
def vector8(j: str) -> str:
    """Bytes q with a scale and a shift: x is about alpha * q + shift."""
    v = vector32(j)
    alpha = f"(array_max({v}) - array_min({v})) / 255"
    return f"named_struct('alpha', {alpha}, 'shift', array_min({v}), 'q', transform({v}, x -> CAST(CASE WHEN {alpha} = 0 THEN 0 ELSE round((x - array_min({v})) / ({alpha})) END AS INT)))"


@macro("vector1bit")
def vector1bit(j: str) -> str:
    """Bits: 1 for components above zero."""
    return f"transform({vector32(j)}, x -> CAST(x > 0 AS INT))"


@macro("vector_extract")
def vector_extract(v: str) -> str:
    return f"to_json({v})"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> double(x) * double(y)), 0.0D, (s, t) -> s + t)"


@macro("vector_distance_cos")
def vector_distance_cos(a: str, b: str) -> str:
    return f"1 - try_divide({dot(a, b)}, sqrt({dot(a, a)} * {dot(b, b)}))"


@macro("vector_distance_l2")
def vector_distance_l2(a: str, b: str) -> str:
    return f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0.0D, (s, t) -> s + t))"


@macro("vector_distance_dot")
def vector_distance_dot(a: str, b: str) -> str:
    return f"-{dot(a, b)}"


@macro("vector_distance_jaccard")
def vector_distance_jaccard(a: str, b: str) -> str:
    side = lambda f: f"aggregate(zip_with({a}, {b}, (x, y) -> {f}(double(x), double(y))), 0.0D, (s, t) -> s + t)"
    return f"1 - try_divide({side('least')}, {side('greatest')})"


@macro("vector_concat")
def vector_concat(*vs: str) -> str:
    return f"concat({', '.join(vs)})"


@macro("vector_slice")
def vector_slice(v: str, s: str, e: str) -> str:
    return f"slice({v}, CAST({s} AS INT) + 1, CAST({e} - {s} AS INT))"


# --- digests, encodings, identifiers -------------------------------------------

for _bits in (256, 384, 512):
    macro(f"crypto_sha{_bits}")(lambda x, b=_bits: f"unhex(sha2({x}, {b}))")
macro("crypto_sha1")(lambda x: f"unhex(sha1({x}))")
macro("crypto_md5")(lambda x: f"unhex(md5({x}))")


@macro("uuid4_str", "gen_random_uuid")
def uuid4_str() -> str:
    return "uuid()"


@macro("uuid4")
def uuid4() -> str:
    return "unhex(replace(uuid(), '-', ''))"


@macro("uuid_str")
def uuid_str(b: str) -> str:
    return f"lower(regexp_replace(hex({b}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5'))"


@macro("uuid_blob")
def uuid_blob(x: str) -> str:
    return f"unhex(replace({text(x)}, '-', ''))"


def uuid7_hex(ms: str) -> str:
    noise = "replace(uuid(), '-', '')"
    return f"concat(lpad(hex({ms}), 12, '0'), '7', substr({noise}, 14, 3), substr('89AB', CAST(rand() * 4 AS INT) + 1, 1), substr({noise}, 18, 15))"


@macro("uuid7")
def uuid7(seconds: str | None = None) -> str:
    ms = "unix_millis(current_timestamp())" if seconds is None else f"({whole(seconds)} * 1000)"
    return f"unhex({uuid7_hex(ms)})"


@macro("uuid7_str")
def uuid7_str(seconds: str | None = None) -> str:
    return uuid_str(uuid7(seconds))


@macro("uuid7_timestamp_ms")
def uuid7_timestamp_ms(u: str) -> str:
    digits = f"CASE WHEN typeof({u}) = 'binary' THEN hex({u}) ELSE replace({text(u)}, '-', '') END"
    return f"CAST(conv(substr({digits}, 1, 12), 16, 10) AS BIGINT)"


@macro("validate_ipaddr")
def validate_ipaddr(x: str) -> str:
    octet = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    v6 = "(([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|([0-9A-Fa-f]{1,4}:){1,7}:|:(:[0-9A-Fa-f]{1,4}){1,7}|([0-9A-Fa-f]{1,4}:){1,6}(:[0-9A-Fa-f]{1,4}){1,6}|::)"
    return f"CASE WHEN {text(x)} RLIKE r'^(({octet}\\.){{3}}{octet}|{v6})(/[0-9]{{1,3}})?$' THEN {x} END"
