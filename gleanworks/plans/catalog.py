"""All registered queries."""

from importlib import import_module

from gleanworks.plans.registry import ORACLES, QUERIES

for _part in ("sources", "rows", "rules", "summaries", "time", "content"):
    import_module(f"gleanworks.plans.catalog_{_part}")

__all__ = ["ORACLES", "QUERIES"]
