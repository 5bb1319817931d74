"""All registered queries but the corpus operators'."""

from tidegrid.plans import boosting_queries, model_queries, panel_queries, profile_queries, statistics_queries  # noqa: F401
from tidegrid.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
