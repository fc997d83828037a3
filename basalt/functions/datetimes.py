"""Date and time functions over text, Julian day numbers and timestamps, with modifiers folded into one expression."""

from __future__ import annotations

import re

from .macros import literal, macro, real, text, unquoted, whole

NUMERIC = "('tinyint', 'smallint', 'int', 'bigint', 'float', 'double')"
DAY = 86_400_000_000  # microseconds
EPOCH = 2440587.5  # Julian day of 1970-01-01


def from_julian(x: str) -> str:
    return f"timestamp_micros(CAST(round(({real(x)} - {EPOCH}D) * 86400000.0D) * 1000 AS BIGINT))"


def from_unix(x: str) -> str:
    return f"timestamp_micros(CAST({real(x)} * 1000000 AS BIGINT))"


def moment(tv: str, kind: str = "") -> str:
    """A time value as a timestamp: text in ISO 8601 or HH:MM alone, ``now``, or a Julian day (``kind`` may say what a number is)."""
    if unquoted(tv) == "now":
        return "current_timestamp()"
    number = f"try_cast({text(tv)} AS DOUBLE)"
    as_number = {"unixepoch": from_unix, "julianday": from_julian, "": from_julian}.get(kind)
    if kind == "auto":
        as_number = lambda n: f"CASE WHEN {n} BETWEEN 0 AND 5373484.4999999 THEN {from_julian(n)} ELSE {from_unix(n)} END"
    plain = text(tv)
    iso = f"{plain} RLIKE r'^\\d{{4}}-\\d{{2}}-\\d{{2}}([ T]\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)?)?\\s*(Z|[+-]\\d{{2}}:\\d{{2}})?$'"
    clock = f"{plain} RLIKE r'^\\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)?$'"
    digits = f"{plain} RLIKE r'^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)\\s*$'"
    n = f"CASE WHEN typeof({tv}) IN {NUMERIC} OR {digits} THEN {number} END"
    return (
        f"CASE WHEN typeof({tv}) IN ('timestamp', 'date', 'timestamp_ntz') OR {iso} THEN try_cast({plain} AS TIMESTAMP) "
        f"WHEN {clock} THEN try_cast(concat('2000-01-01 ', {plain}) AS TIMESTAMP) ELSE {as_number(n)} END"
    )


def add_months(ts: str, n: str, clamp: bool) -> str:
    """Months later at the same time of day; a day past the month's end rolls over, or clamps to it."""
    day = f"add_months({ts}, {n})" if clamp else f"date_add(trunc(add_months({ts}, {n}), 'MM'), day({ts}) - 1)"
    return f"(CAST({day} AS TIMESTAMP) + ({ts} - date_trunc('DAY', {ts})))"


UNITS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": DAY}


def modify(ts: str, modifier: str, following: str) -> str:
    m = modifier.strip().lower()
    if hit := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) *(second|minute|hour|day|month|year)s?", m):
        n, unit = float(hit[1]), hit[2]
        if unit in UNITS:
            return f"timestamp_micros(unix_micros({ts}) + {round(n * UNITS[unit])}L)"
        return add_months(ts, str(int(n) * (12 if unit == "year" else 1)), following == "floor")
    if hit := re.fullmatch(r"([+-]?)(\d\d):(\d\d)(?::(\d\d(?:\.\d+)?))?", m):
        seconds = int(hit[2]) * 3600 + int(hit[3]) * 60 + float(hit[4] or 0)
        return f"timestamp_micros(unix_micros({ts}) + {round(seconds * 1e6) * (-1 if hit[1] == '-' else 1)}L)"
    if hit := re.fullmatch(r"([+-])(\d{4})-(\d\d)-(\d\d)(?: (\d\d:\d\d(?::\d\d(?:\.\d+)?)?))?", m):
        sign = hit[1]
        ts = add_months(ts, str((int(hit[2]) * 12 + int(hit[3])) * (-1 if sign == "-" else 1)), following == "floor")
        ts = modify(ts, f"{sign}{int(hit[4])} days", "")
        return modify(ts, sign + hit[5], "") if hit[5] else ts
    if m in ("start of month", "start of year", "start of day"):
        return f"date_trunc('{m.rsplit(' ', 1)[1].upper()}', {ts})"
    if hit := re.fullmatch(r"weekday ([0-6])(\.0*)?", m):
        ahead = f"pmod({int(hit[1])} + 1 - dayofweek({ts}), 7)"
        return f"timestamp_micros(unix_micros({ts}) + {ahead} * {DAY}L)"
    if m in ("utc", "localtime", "floor", "ceiling", "subsec", "subsecond", "unixepoch", "julianday", "auto"):
        return ts  # the session's zone is UTC; the others are read elsewhere
    return "CAST(NULL AS TIMESTAMP)"


def folded(args: tuple[str, ...]) -> tuple[str, bool]:
    """The timestamp that a time value and its literal modifiers make, and whether fractions of a second are asked for."""
    tv, *modifiers = args or ("'now'",)
    values = [unquoted(m) for m in modifiers]
    if unquoted(tv) in ("subsec", "subsecond"):
        tv, values = "'now'", ["subsec", *values]
    if None in values:
        raise ValueError("modifiers must be text literals")
    lower = [v.strip().lower() for v in values]
    kind = next((v for v in lower if v in ("unixepoch", "julianday", "auto")), "")
    ts = f"({moment(tv, kind)})"
    for i, v in enumerate(values):
        ts = f"({modify(ts, v, lower[i + 1] if i + 1 < len(lower) else '')})"
    return ts, "subsec" in lower or "subsecond" in lower


@macro("date")
def date(*args: str) -> str:
    return f"date_format({folded(args)[0]}, 'yyyy-MM-dd')"


@macro("time")
def time(*args: str) -> str:
    ts, fine = folded(args)
    return f"date_format({ts}, '{'HH:mm:ss.SSS' if fine else 'HH:mm:ss'}')"


@macro("datetime")
def datetime(*args: str) -> str:
    ts, fine = folded(args)
    return f"date_format({ts}, '{'yyyy-MM-dd HH:mm:ss.SSS' if fine else 'yyyy-MM-dd HH:mm:ss'}')"


def julian(ts: str) -> str:
    return f"unix_micros({ts}) / {DAY}.0D + {EPOCH}D"


@macro("julianday")
def julianday(*args: str) -> str:
    return julian(folded(args)[0])


@macro("unixepoch")
def unixepoch(*args: str) -> str:
    ts, fine = folded(args)
    return f"unix_millis({ts}) / 1000.0D" if fine else f"unix_seconds({ts})"


#: Format codes by the pattern letters that print them.
CODES = {"d": "dd", "F": "yyyy-MM-dd", "H": "HH", "I": "hh", "j": "DDD", "m": "MM", "M": "mm", "R": "HH:mm", "S": "ss", "T": "HH:mm:ss", "Y": "yyyy"}


@macro("strftime")
def strftime(fmt: str, *args: str) -> str:
    ts, _ = folded(args)
    form, parts, i = unquoted(fmt), [], 0
    if form is None:
        raise ValueError("the format must be a text literal")
    sunday = f"(dayofweek({ts}) - 1)"
    blank = lambda x: f"lpad(CAST({x} AS STRING), 2, ' ')"
    hour12 = f"((hour({ts}) + 11) % 12 + 1)"
    other = {
        "e": blank(f"day({ts})"), "f": f"date_format({ts}, 'ss.SSS')", "J": f"CAST({julian(ts)} AS STRING)", "k": blank(f"hour({ts})"), "l": blank(hour12),
        "p": f"IF(hour({ts}) < 12, 'AM', 'PM')", "P": f"IF(hour({ts}) < 12, 'am', 'pm')", "s": f"CAST(unix_seconds({ts}) AS STRING)", "w": f"CAST({sunday} AS STRING)",
        "u": f"CAST(pmod({sunday} + 6, 7) + 1 AS STRING)", "W": f"lpad(CAST((dayofyear({ts}) + 6 - pmod({sunday} + 6, 7)) div 7 AS STRING), 2, '0')",
        "U": f"lpad(CAST((dayofyear({ts}) + 6 - {sunday}) div 7 AS STRING), 2, '0')", "V": f"lpad(CAST(weekofyear({ts}) AS STRING), 2, '0')",
        "G": f"CAST(extract(YEAROFWEEK FROM {ts}) AS STRING)", "%": "'%'",
    }
    while i < len(form):
        if form[i] == "%" and i + 1 < len(form):
            code = form[i + 1]
            if code in CODES:
                parts.append(f"date_format({ts}, '{CODES[code]}')")
            elif code in other:
                parts.append(other[code])
            else:
                return "CAST(NULL AS STRING)"
            i += 2
        else:
            end = form.find("%", i + 1)
            end = len(form) if end < 0 else end
            parts.append(literal(form[i:end]))
            i = end
    return f"CASE WHEN {ts} IS NOT NULL THEN concat({', '.join(parts)}) END" if parts else "''"


@macro("timediff")
def timediff(a: str, b: str) -> str:
    """``+YYYY-MM-DD HH:MM:SS.SSS``: the whole months from the earlier to the later, then the rest."""
    x, y = f"({moment(a)})", f"({moment(b)})"
    low, high = f"least({x}, {y})", f"greatest({x}, {y})"
    guess = f"((year({high}) - year({low})) * 12 + month({high}) - month({low}))"
    months = f"(CASE WHEN {add_months(low, guess, False)} > {high} THEN {guess} - 1 ELSE {guess} END)"
    rest = f"(unix_micros({high}) - unix_micros({add_months(low, months, False)}))"
    pad = lambda v, n: f"lpad(CAST({v} AS STRING), {n}, '0')"
    clock = f"date_format(timestamp_micros({rest} % {DAY}L), 'HH:mm:ss.SSS')"
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN concat(IF({x} >= {y}, '+', '-'), {pad(f'{months} div 12', 4)}, '-', {pad(f'{months} % 12', 2)}, '-', {pad(f'{rest} div {DAY}L', 2)}, ' ', {clock}) END"


# --- the time extension: values are timestamps -----------------------------------


def stamp(t: str) -> str:
    return f"CAST({t} AS TIMESTAMP)"


macro("time_now", "now")(lambda: "current_timestamp()")


@macro("time_date", "make_timestamp")
def time_date(y: str, m: str, d: str, h: str = "0", mi: str = "0", s: str = "0") -> str:
    return f"make_timestamp({y}, {m}, {d}, {h}, {mi}, {s})"


macro("make_date")(lambda y, m, d: f"CAST(make_date({y}, {m}, {d}) AS TIMESTAMP)")
FIELDS = {
    "year": "year({0})", "month": "month({0})", "day": "day({0})", "hour": "hour({0})", "minute": "minute({0})", "second": "second({0})",
    "nano": "(unix_micros(CAST({0} AS TIMESTAMP)) % 1000000) * 1000", "weekday": "dayofweek({0}) - 1", "yearday": "dayofyear({0})", "isoyear": "extract(YEAROFWEEK FROM {0})", "isoweek": "weekofyear({0})",
    "quarter": "quarter({0})", "decade": "year({0}) div 10", "century": "(year({0}) + 99) div 100", "millennium": "(year({0}) + 999) div 1000",
    "milli": "(unix_micros(CAST({0} AS TIMESTAMP)) % 1000000) div 1000", "micro": "unix_micros(CAST({0} AS TIMESTAMP)) % 1000000", "epoch": "unix_seconds(CAST({0} AS TIMESTAMP))",
}
for _field in ("year", "month", "day", "hour", "minute", "second", "nano", "weekday", "yearday", "isoyear", "isoweek"):
    macro(f"time_get_{_field}")(lambda t, f=_field: whole(FIELDS[f].format(t)))


@macro("time_get", "date_part")
def time_get(t: str, field: str) -> str:
    name = (unquoted(field) or "").lower()
    if name not in FIELDS and unquoted(t):  # date_part takes the field first
        t, name = field, unquoted(t).lower()
    return whole(FIELDS[name].format(t))


macro("time_unix", "to_timestamp")(lambda s: f"timestamp_seconds({s})")
macro("time_milli")(lambda x: f"timestamp_millis({x})")
macro("time_micro")(lambda x: f"timestamp_micros({x})")
macro("time_nano")(lambda x: f"timestamp_micros({x} div 1000)")
macro("time_to_unix")(lambda t: f"unix_seconds({stamp(t)})")
macro("time_to_milli")(lambda t: f"unix_millis({stamp(t)})")
macro("time_to_micro")(lambda t: f"unix_micros({stamp(t)})")
macro("time_to_nano")(lambda t: f"unix_micros({stamp(t)}) * 1000")
macro("time_after")(lambda a, b: f"CAST({a} > {b} AS INT)")
macro("time_before")(lambda a, b: f"CAST({a} < {b} AS INT)")
macro("time_equal")(lambda a, b: f"CAST({a} = {b} AS INT)")
macro("time_compare")(lambda a, b: f"CASE WHEN {a} < {b} THEN -1 WHEN {a} > {b} THEN 1 WHEN {a} = {b} THEN 0 END")
#: Durations are nanoseconds.
NANOS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
for _unit, _n in NANOS.items():
    macro(f"dur_{_unit}")(lambda n=_n: f"{n}L")
macro("time_add")(lambda t, d: f"timestamp_micros(unix_micros({stamp(t)}) + {whole(d)} div 1000)")
macro("time_sub", "age")(lambda a, b: f"(unix_micros({stamp(a)}) - unix_micros({stamp(b)})) * 1000")
macro("time_since")(lambda t: f"(unix_micros(current_timestamp()) - unix_micros({stamp(t)})) * 1000")
macro("time_until")(lambda t: f"(unix_micros({stamp(t)}) - unix_micros(current_timestamp())) * 1000")


@macro("time_add_date", "date_add_ext")
def time_add_date(t: str, years: str, months: str = "0", days: str = "0") -> str:
    moved = add_months(stamp(t), f"CAST({years} * 12 + {months} AS INT)", False)
    return f"timestamp_micros(unix_micros({stamp(moved)}) + {days} * {DAY}L)"


def duration_micros(d: str) -> str:
    return f"greatest({whole(d)} div 1000, 1L)"


@macro("time_trunc")
def time_trunc(t: str, d: str) -> str:
    """To a field name, or to a multiple of a duration."""
    if field := unquoted(d):
        return f"date_trunc('{field.upper()}', {t})"
    return f"timestamp_micros(unix_micros({stamp(t)}) - pmod(unix_micros({stamp(t)}), {duration_micros(d)}))"


@macro("date_trunc")
def date_trunc(field: str, t: str) -> str:
    return f"date_trunc({field}, {t})"


@macro("time_round")
def time_round(t: str, d: str) -> str:
    u = duration_micros(d)
    return f"timestamp_micros((unix_micros({stamp(t)}) + {u} div 2) - pmod(unix_micros({stamp(t)}) + {u} div 2, {u}))"


macro("time_fmt_iso")(lambda t: f"date_format({t}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
macro("time_fmt_datetime")(lambda t: f"date_format({t}, 'yyyy-MM-dd HH:mm:ss')")
macro("time_fmt_date")(lambda t: f"date_format({t}, 'yyyy-MM-dd')")
macro("time_fmt_time")(lambda t: f"date_format({t}, 'HH:mm:ss')")
macro("time_parse")(lambda x: f"try_cast({text(x)} AS TIMESTAMP)")
