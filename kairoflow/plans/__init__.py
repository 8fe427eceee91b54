"""Registered queries over the driver's tables and their SQL."""

from kairoflow.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
