"""Registered queries over the driver tables, with their SQL twins."""

from folioscope.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
