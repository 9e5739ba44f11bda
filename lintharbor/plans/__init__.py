"""The registered queries and their SQL."""

from . import more_queries, round_trips  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
