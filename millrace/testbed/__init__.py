"""Registered queries over the test tables, each with its SQL twin where SQL can say it."""

from millrace.testbed import models, runs, scans, shaping  # noqa: F401  (registers queries)
from millrace.testbed.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
