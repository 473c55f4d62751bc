"""All registered queries and their SQL."""

from __future__ import annotations

from isochord.plans import (alignment, content, nulls, spaces, statistics,  # noqa: F401
                            streams)
from isochord.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
