"""Registered queries and their oracle SQL."""

from tidemark.plans import alerts, boards, detail, feeds, news, runs, screens  # noqa: F401 - register their queries
from tidemark.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
