"""Inputs derived from the driver tables, with the registered queries and their SQL."""

from ripplemap.bridge import q_catalog, q_changes, q_decisions, q_graph, q_marts  # noqa: F401
from ripplemap.bridge.registry import ORACLES, QUERIES
from ripplemap.bridge.tables import Driver

__all__ = ["ORACLES", "QUERIES", "Driver"]
