"""Recursive queries that end where a distinct union adds nothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.operators.staging import staged

MERGE = 16


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int | None = None) -> DataFrame:
    """All rows that ``step`` reaches from ``start``, each once: cycles end.

    A round applies the step to the rows of the round before, and keeps those
    that are new (NULLs equal each other). A round writes its new rows alone to
    the shared checkpoint folder; all of them are written together only every
    MERGE rounds, to keep plans short. Rounds are as many as the longest path;
    ``limit``, if given, is the most that are tried before an error.
    """
    columns = start.columns
    new = staged(start.distinct())
    parts = [new]
    for done in count():
        if done == limit:
            raise RuntimeError(f"no fixed point within {limit} rounds")
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        if len(parts) >= MERGE:
            parts = [staged(found)]
            found = parts[0]
        reached = step(new).toDF(*columns).distinct()
        same = reduce(and_, (F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in columns))
        new = staged(reached.alias("r").join(found.alias("f"), same, "left_anti"))
        if new.isEmpty():
            return found
        parts.append(new)
