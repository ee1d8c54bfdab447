"""Queries by name over the driver's tables, with the SQL that says the same."""

from responsa.plans import extra, more, neighbors, scalar, splits, stats
from responsa.plans.registry import ORACLES, QUERIES, ROWS

__all__ = ["ORACLES", "QUERIES", "ROWS", "extra", "more", "neighbors", "scalar", "splits", "stats"]
