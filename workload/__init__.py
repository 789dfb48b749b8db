"""Registered queries: each one runs an operator over whole given tables."""

from workload.base import ORACLES, QUERIES
from workload import news, pages, roster  # noqa: F401  (registers the queries)

__all__ = ["ORACLES", "QUERIES"]
