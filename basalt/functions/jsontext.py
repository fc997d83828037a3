"""JSON as text: key order, repeated keys and the digits of numbers survive; paths as ``$.key[0]["key"][#-1]``."""

from __future__ import annotations

import json
import re


class Number(str):
    """A number by its digits."""

    @property
    def whole(self) -> bool:
        return not any(c in self for c in ".eE") and self.lstrip("+-").isdigit()


class Pairs(list):
    """An object's (key, value) pairs in order."""


MISSING = object()


def parse(text: str):
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=refuse, object_pairs_hook=Pairs)
    except json.JSONDecodeError:
        raise ValueError("malformed JSON") from None


def refuse(name: str):
    raise json.JSONDecodeError(f"no {name}", name, 0)


def error_position(text: str) -> int:
    """1-based place of the first error, 0 if there is none."""
    try:
        json.loads(text, parse_constant=refuse)
        return 0
    except json.JSONDecodeError as e:
        return e.pos + 1


def value(v):
    """An SQL value as JSON: texts stay texts."""
    return v


def dump(v) -> str:
    if isinstance(v, Pairs):
        return "{" + ",".join(f"{quote(k)}:{dump(x)}" for k, x in v) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dump, v)) + "]"
    if isinstance(v, Number):
        return str(v)
    if isinstance(v, str):
        return quote(v)
    return {None: "null", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else json.dumps(v)


def quote(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def pretty(v, indent: str, depth: int = 0) -> str:
    pad, end = "\n" + indent * (depth + 1), "\n" + indent * depth
    if isinstance(v, Pairs) and v:
        return "{" + ",".join(f"{pad}{quote(k)}: {pretty(x, indent, depth + 1)}" for k, x in v) + end + "}"
    if isinstance(v, list) and v and not isinstance(v, Pairs):
        return "[" + ",".join(pad + pretty(x, indent, depth + 1) for x in v) + end + "]"
    return dump(v)


def plain(v) -> str | None:
    """As an SQL text: a text without quotes, booleans as 1 and 0, the rest as JSON."""
    if v is MISSING or v is None:
        return None
    if isinstance(v, bool):
        return str(int(v))
    return str(v) if isinstance(v, str) else dump(v)


def kind(v) -> str | None:
    if v is MISSING:
        return None
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, Number):
        return "integer" if v.whole else "real"
    return "object" if isinstance(v, Pairs) else "array" if isinstance(v, list) else "text"


STEP = re.compile(r'\.(?:"([^"]*)"|([^.\[]+))|\[(?:(\d+)|#(?:-(\d+))?|"([^"]*)")\]')


def steps(path: str) -> list[tuple[str, object]]:
    """("key", name), ("index", n), or ("end", n): n before one past the last."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path: {path}")
    out, at = [], 1
    while at < len(path):
        m = STEP.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path: {path}")
        quoted, bare, index, back, bracket = m.groups()
        key = next((k for k in (quoted, bare, bracket) if k is not None), None)
        out.append(("key", key) if key is not None else ("index", int(index)) if index is not None else ("end", int(back or 0)))
        at = m.end()
    return out


def short_path(p: str) -> str:
    """An index, a key or a path, as the arrow operators take it."""
    if re.fullmatch(r"\d+", p):
        return f"$[{p}]"
    if re.fullmatch(r"-\d+", p):
        return f"$[#{p}]"
    return p if p.startswith("$") else f'$."{p}"'


def slot(v, step) -> object:
    """The place of a step in a container, or MISSING."""
    how, arg = step
    if how == "key":
        return next((i for i, (k, _) in enumerate(v) if k == arg), MISSING) if isinstance(v, Pairs) else MISSING
    if not isinstance(v, list) or isinstance(v, Pairs):
        return MISSING
    i = arg if how == "index" else len(v) - arg
    return i if 0 <= i < len(v) else MISSING


def find(v, path: str):
    for step in steps(path):
        i = slot(v, step)
        if i is MISSING:
            return MISSING
        v = v[i][1] if isinstance(v, Pairs) else v[i]
    return v


def put(v, path: str, new, mode: str):
    """Set, insert (only where nothing is) or replace (only where something is) at a path; missing parents of a key are made."""

    def at(node, todo):
        if not todo:
            return node if mode == "insert" else new
        i = slot(node, todo[0])
        if i is not MISSING:
            if isinstance(node, Pairs):
                return Pairs([(k, at(x, todo[1:]) if j == i else x) for j, (k, x) in enumerate(node)])
            return [at(x, todo[1:]) if j == i else x for j, x in enumerate(node)]
        if mode == "replace":
            return node
        how, arg = todo[0]
        made = new if len(todo) == 1 else at(Pairs() if todo[1][0] == "key" else [], todo[1:])
        if how == "key" and isinstance(node, Pairs):
            return Pairs([*node, (arg, made)])
        if how != "key" and isinstance(node, list) and not isinstance(node, Pairs) and (arg == len(node) if how == "index" else arg == 0):
            return [*node, made]
        return node

    return at(v, steps(path))


def remove(v, paths: list[str]):
    def without(node, todo):
        i = slot(node, todo[0])
        if i is MISSING:
            return node
        rest = [x for j, x in enumerate(node) if j != i] if len(todo) == 1 else None
        if rest is None:
            rest = [((x[0], without(x[1], todo[1:])) if isinstance(node, Pairs) else without(x, todo[1:])) if j == i else x for j, x in enumerate(node)]
        return Pairs(rest) if isinstance(node, Pairs) else rest

    for path in paths:
        todo = steps(path)
        v = without(v, todo) if todo else None
    return v


def patch(target, change):
    """A merge patch (RFC 7396): nulls delete, objects merge, all else replaces."""
    if not isinstance(change, Pairs):
        return change
    out = Pairs(target) if isinstance(target, Pairs) else Pairs()
    for key, new in change:
        at = next((i for i, (k, _) in enumerate(out) if k == key), None)
        if new is None:
            out = Pairs([p for p in out if p[0] != key])
        elif at is None:
            out.append((key, patch(None, new)))
        else:
            out[at] = (key, patch(out[at][1], new))
    return out
