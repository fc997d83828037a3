"""Declared tables: column types, defaults, keys and checks; sequences."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators import changes, types
from basalt.plans.dialect import rewrite, show, split_by, upper

KINDS = {"integer": "bigint", "real": "double", "text": "string", "blob": "binary", "numeric": "double"}
#: Words that end a column's type and begin a constraint.
CONSTRAINTS = {"PRIMARY", "NOT", "NULL", "UNIQUE", "CHECK", "DEFAULT", "REFERENCES", "COLLATE", "GENERATED", "AS", "CONSTRAINT", "AUTOINCREMENT", "ON", "ASC", "DESC"}


class ConstraintError(ValueError):
    """A change would break a declared constraint; the table stays as it was."""


@dataclass
class Sequence:
    """A counter on the driver, for the values that statements ask for."""

    start: int = 1
    step: int = 1
    last: int | None = None

    def call(self, what: str, args: list[str]) -> int:
        if what == "NEXTVAL":
            self.last = self.start if self.last is None else self.last + self.step
        elif what == "SETVAL":
            self.last = int(args[0])
        elif self.last is None:
            raise ValueError("currval: the sequence was not read yet")
        return self.last


@dataclass
class Schema:
    types: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    needed: list[str] = field(default_factory=list)
    keys: list[list[str]] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, nodes: list, domains: dict[str, list]) -> Schema:
        """The columns and constraints between the brackets of CREATE TABLE. References are taken and not tested."""
        out = cls()
        for part in split_by(nodes):
            words = [upper(n) for n in part]
            if words[0] == "CONSTRAINT":
                part, words = part[2:], words[2:]
            if words[0] in ("PRIMARY", "UNIQUE") and isinstance(part[-1], list):
                out.keys.append([c.strip("`") for c in part[-1][1:-1] if c != ","])
            elif words[0] == "CHECK":
                out.checks[f"check {len(out.checks) + 1}"] = rewrite(show(part[1][1:-1]))
            elif words[0] != "FOREIGN":
                name, rest = part[0].strip("`"), part[1:]
                if rest and isinstance(rest[0], str) and rest[0].lower() in domains:
                    rest = [*(name if upper(n) == "VALUE" else [name if upper(m) == "VALUE" else m for m in n] if isinstance(n, list) else n for n in domains[rest[0].lower()]), *rest[1:]]
                end = next((i for i, n in enumerate(rest) if upper(n) in CONSTRAINTS), len(rest))
                out.types[name] = KINDS[types.affinity(show(rest[:end]))]
                out.column(name, rest[end:])
        out.keys = [k for i, k in enumerate(out.keys) if k not in out.keys[:i]]
        return out

    def column(self, name: str, rest: list) -> None:
        for i, n in enumerate(rest):
            word = upper(n)
            if word == "PRIMARY" or word == "UNIQUE":
                self.keys.append([name])
            elif word == "NOT" and i + 1 < len(rest) and upper(rest[i + 1]) == "NULL":
                self.needed.append(name)
            elif word == "CHECK":
                self.checks[f"check of {name}"] = rewrite(show(rest[i + 1][1:-1]))
            elif word == "DEFAULT":
                sign = rest[i + 1] in ("-", "+")
                self.defaults[name] = rewrite(show(rest[i + 1 : i + 2 + sign]))

    def conditions(self) -> dict[str, Column]:
        return {f"{c} is not null": F.col(c).isNotNull() for c in self.needed} | {n: F.expr(e) for n, e in self.checks.items()}

    def row_holds(self) -> Column:
        """Whether a row alone breaks nothing: a check that is NULL holds."""
        return reduce(and_, (F.coalesce(c.cast("boolean"), F.lit(True)) for c in self.conditions().values()), F.lit(True))

    def test(self, df: DataFrame) -> None:
        """Raise for the first constraint that some row breaks: one query for the checks, one for each key."""
        conditions = {n: c.cast("boolean") for n, c in self.conditions().items()}
        if not conditions and not self.keys:
            return
        for r in changes.violations(df, conditions, {f"key ({', '.join(k)})": k for k in self.keys}).collect():
            if r["n"]:
                raise ConstraintError(f"{r['constraint']}: broken by {r['n']} rows or keys")
