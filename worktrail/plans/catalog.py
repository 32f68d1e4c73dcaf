"""All registered queries."""

from worktrail.plans import queries_aggregates, queries_filters, queries_functions, queries_ranking, queries_search, queries_state  # noqa: F401
from worktrail.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
