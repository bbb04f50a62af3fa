"""Queries: the operators bound to tables, each with SQL where SQL can say it."""

from visitloom.plans import model_queries, scalar_queries, source_queries, table_queries  # noqa: F401
from visitloom.plans.registry import QUERIES, SQL  # noqa: F401
