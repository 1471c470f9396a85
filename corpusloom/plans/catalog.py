"""All registered queries and their SQL."""

from . import cases, more_queries, record_queries, reference_queries, relational_queries, streaming_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
