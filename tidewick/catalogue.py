"""All queries of the market-structure engine and their SQL."""

from __future__ import annotations

from .plans import cones, features, occasions, pages, reports, signals, structures, studies, volume  # noqa: F401
from .plans.registry import ORACLES, QUERIES

FLAGSHIP = "volume_spike"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
