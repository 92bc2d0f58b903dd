"""Queries of the library and their SQL."""

from __future__ import annotations

from corpusmith.plans import answers, chats, formatting, kernels, relations  # noqa: F401  (they register their queries)
from corpusmith.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
