"""Registered queries and their SQL."""

from . import reports, retrieval  # noqa: F401  register their queries
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
