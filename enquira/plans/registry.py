"""Names, callables and check SQL of all queries outside the optional subpackage."""

from __future__ import annotations

from importlib import import_module

from .entries import ORACLES, QUERIES

for _name in ("catalog", "leads", "scoring", "retrieval", "sessions", "routing", "evaluation", "mltables", "models", "forms", "pages", "stores"):
    import_module(f"enquira.plans.q_{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
