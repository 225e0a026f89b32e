"""All registered queries."""

from lectern.plans import book_queries, chapter_queries, slide_queries, text_queries  # noqa: F401
from lectern.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
