"""The engine's queries, with SQL that finds their results from the tables directly."""

from leafgraph.plans import queries, views
from leafgraph.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "queries", "views"]
