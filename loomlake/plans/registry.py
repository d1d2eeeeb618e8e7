"""All registered queries of the library outside ``llm`` and their SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict = {}
for _name in ("geometry", "references", "rollouts", "text", "mixing", "flows", "outputs", "traces", "evidence", "building", "records"):
    _plans = import_module(f"loomlake.plans.{_name}")
    QUERIES |= _plans.QUERIES
    ORACLES |= _plans.ORACLES
