"""All registered queries."""

import importlib

from leadloom.plans.base import ORACLES, QUERIES

for _area in ("leads", "dedup", "funnel", "evidence", "discovery", "web", "commerce", "streams"):
    importlib.import_module(f"leadloom.plans.{_area}")

__all__ = ["ORACLES", "QUERIES"]
