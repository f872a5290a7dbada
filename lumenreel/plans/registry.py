"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from lumenreel.plans import changes, fields, landing, listings, markup, merging, people, persisting, resolving, serving, texts  # noqa: F401  (they register their queries)
from lumenreel.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
