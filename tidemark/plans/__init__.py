"""Registered queries: the operators bound to the tables, each with its SQL where SQL can express it."""

from tidemark.plans import content, entities, feeds, forecasts, governance, lexicons, monitoring, relational, reports, retrieval, series, text, topics  # noqa: F401
from tidemark.plans.registry import ORACLE, QUERIES  # noqa: F401
