"""Registered queries and, where SQL can express them, their check queries."""

from wirelens.catalog.registry import ORACLES, QUERIES
from wirelens.catalog import alerts, flows, landed, models, packets, prep, streams, triage  # noqa: F401  (fill the registry)

__all__ = ["ORACLES", "QUERIES"]
