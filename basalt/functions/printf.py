"""printf over SQL values: missing values are 0 or empty, wrong types are converted."""

from __future__ import annotations

import re

SPEC = re.compile(r"%([-+ #0,!]*)(\*|\d+)?(?:\.(\*|\d+))?(?:hh|h|ll|l|j|z|t)?([a-zA-Z%])")


def number(v) -> float:
    if isinstance(v, str):
        m = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v)
        return float(m[0]) if m else 0.0
    return 0.0 if v is None else float(v)


def whole(v) -> int:
    return v if isinstance(v, int) else int(number(v))


def printf(form: str, args: list) -> str:
    left = list(args)
    take = lambda: left.pop(0) if left else None

    def one(m: re.Match) -> str:
        flags, width, precision, code = m.groups()
        if code == "%":
            return "%"
        width = whole(take()) if width == "*" else int(width or 0)
        precision = whole(take()) if precision == "*" else None if precision is None else int(precision)
        if width < 0:
            flags, width = flags + "-", -width
        sign = "+" if "+" in flags else " " if " " in flags else ""
        zero = "0" in flags and "-" not in flags
        if code in "di":
            v = whole(take())
            digits = str(abs(v)).rjust(precision or 1, "0")
            digits = f"{int(digits):,}" if "," in flags else digits
            body, lead = digits, "-" if v < 0 else sign
        elif code == "u":
            body, lead = str(whole(take()) % (1 << 64)), ""
        elif code in "xXo":
            v = whole(take()) % (1 << 64)
            body = format(v, code)
            lead = {"x": "0x", "X": "0X", "o": "0"}[code] if "#" in flags and v else ""
        elif code in "feEgG":
            v = number(take())
            body = format(abs(v), f"{',' if ',' in flags else ''}.{6 if precision is None else precision}{code}")
            lead = "-" if v < 0 else sign
        elif code in "sz":
            v = take()
            body, lead, zero = "" if v is None else str(v), "", False
            body = body if precision is None else body[:precision]
        elif code == "c":
            v = take()
            body, lead, zero = ("" if v is None else str(v))[:1], "", False
        elif code in "qQw":
            v = take()
            lead, zero = "", False
            body = ("NULL" if code == "Q" else "(NULL)") if v is None else str(v).replace("'", "''") if code != "w" else str(v).replace('"', '""')
            body = f"'{body}'" if code == "Q" and v is not None else body
        else:
            return ""
        if zero:
            body = body.rjust(width - len(lead), "0")
        out = lead + body
        return out.ljust(width) if "-" in flags else out.rjust(width)

    return SPEC.sub(one, form)
