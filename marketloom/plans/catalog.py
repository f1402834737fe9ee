"""Imports every module that registers queries."""

from marketloom.plans import analysis, features, market, monitoring, text  # noqa: F401
from marketloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
