"""The registered queries of the engine's own operators and their SQL."""

from __future__ import annotations

from importlib import import_module

from inkfathom.registry import ORACLES, QUERIES

for _module in ("search", "graph", "analytics", "scalars", "ingest", "streams", "extras", "answers", "building", "operations", "paths", "sparse", "stores", "sessions", "linking"):
    import_module(f"inkfathom.plans.{_module}")

ENTRY = "rrf_weighted_fields"

__all__ = ["ENTRY", "ORACLES", "QUERIES"]
