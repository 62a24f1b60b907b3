"""The registered queries."""

from quillon.plans import event_queries, extra_queries, route_queries, score_queries, text_queries, write_queries  # noqa: F401
from quillon.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
