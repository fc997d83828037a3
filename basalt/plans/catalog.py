"""All registered queries: importing this module fills the registry."""

from basalt.plans import programs, relational, scalars  # noqa: F401
from basalt.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
