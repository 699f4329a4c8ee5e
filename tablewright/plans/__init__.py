"""The operators put to work on the given tables, each with the SQL that says the same."""

from tablewright.plans import changes, files, flagship, relations, rows, shapes, streams, texts  # noqa: F401
from tablewright.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
