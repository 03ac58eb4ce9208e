"""All queries of the transit engine with their SQL equivalents."""

from __future__ import annotations

from tripweave.plans import demand, functions, insertion, routes, scans, solver
from tripweave.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "demand", "functions", "insertion", "routes", "scans", "solver"]
