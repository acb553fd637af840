"""All relational queries with their oracles."""

from sprucelake.plans import analytics, large_keys, relational, scalars, streams, text
from sprucelake.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics", "large_keys", "relational", "scalars", "streams", "text"]
