"""Registered queries, grouped by what they read."""

from quire.plans import (  # noqa: F401
    layout_queries,
    ledger_queries,
    library_queries,
    page_queries,
    reflect_queries,
    search_queries,
    stream_queries,
)
from quire.plans.registry import ORACLE, QUERIES  # noqa: F401
