"""Registered queries, by subject."""

from millrace.plans import dashboard, decision, history, realtime, summaries, timelines, warehouse  # noqa: F401
from millrace.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
