"""All registered queries of the library proper."""

from assetloom.plans import details, layers, pixels, relational  # noqa: F401  they register themselves
from assetloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
