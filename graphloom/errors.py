"""Errors raised by the engine before or during a query."""

from __future__ import annotations


class GraphQueryError(ValueError):
    """A pattern that cannot be parsed, resolved or validated."""


class QueryTimeout(RuntimeError):
    """A query was cancelled because it ran past its time limit."""
