"""All queries of the library."""

from __future__ import annotations

from .queries import audit, baskets, boundaries, collation, diachronic, estimates, evidence, graphs, language, matching, profiles, readers, rediscovery, relational, resampling, senses, sequences, stores, streams, text, transmission  # noqa: F401  each adds its queries
from .registry import QUERIES, Query

__all__ = ["QUERIES", "Query"]
