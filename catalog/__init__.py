"""Queries over the test tables, each with the SQL that gives the same result where SQL can."""

from catalog import cleaning, duplicates, joining, profiling, storing  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
