"""The registered queries over the tables, and their SQL."""

from cubeframe.plans.arrays import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
