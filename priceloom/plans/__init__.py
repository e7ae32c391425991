"""Registered queries over the driver tables."""

from priceloom.plans import cleaning, modelling, serving, statistics  # noqa: F401
from priceloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
