"""Queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from . import books, chunks, evaluation, retrieval, sources, stored, texts  # noqa: F401  each registers its queries
from .tables import ORACLE_SQL, QUERIES

FLAGSHIP = "hybrid_search"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
