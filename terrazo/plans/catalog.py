"""All registered queries of the engine."""

from __future__ import annotations

from terrazo.plans import core, geometry, statistics  # noqa: F401  each registers its queries
from terrazo.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "entity_report"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
