"""All registered queries: importing this module fills the registry."""

from shopsight.plans import analysis, io_queries, modeling, registry  # noqa: F401  (importing registers the queries)
from shopsight.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
