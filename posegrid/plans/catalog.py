"""All queries and their SQL."""

from posegrid.plans import checks, files, motion, projections, windows  # noqa: F401  they register themselves
from posegrid.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
