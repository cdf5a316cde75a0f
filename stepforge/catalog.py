"""Registered queries over the driver's tables and their SQL equivalents."""

from stepforge.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
