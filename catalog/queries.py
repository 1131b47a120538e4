"""All registered queries."""

from catalog import documents, relations, scalars, scans  # noqa: F401
from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
