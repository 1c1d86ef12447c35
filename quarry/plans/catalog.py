"""All queries of the library's own operators."""

from __future__ import annotations

from quarry.plans import evaluation, more, online, relational, scalars, search  # noqa: F401  (each registers its queries)
from quarry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
