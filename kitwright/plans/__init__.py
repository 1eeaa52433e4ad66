"""Named queries: operators bound to the driver's tables, each with its SQL."""

from kitwright.plans import accounts, answers, builds, extended, stored  # noqa: F401  (they register their queries)
from kitwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
