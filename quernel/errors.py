"""Errors of the dialect."""

from __future__ import annotations


class QueryError(ValueError):
    """A statement that the dialect rejects."""


class NotSupported(QueryError):
    """A statement of cluster administration: recognised, never executed here."""
