"""The registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from importlib import import_module

from rankloom.plans.registry import ORACLES, QUERIES

MODULES = ["retrieval", "evaluation", "structure", "reports", "rules", "terms", "audits"]

for _name in MODULES:
    import_module(f"rankloom.plans.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
