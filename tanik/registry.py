"""All queries of the library over the given tables, with DuckDB twins."""

from __future__ import annotations

from tanik.plans import crawl, logs, news, stories, streams  # noqa: F401  these register their queries
from tanik.plans.query import ORACLES, QUERIES

FLAGSHIP = "j_events"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
