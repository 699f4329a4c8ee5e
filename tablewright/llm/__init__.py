"""Operators for preparing training text, and the queries that apply them to the given tables."""

from tablewright.llm.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
