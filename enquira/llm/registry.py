"""Queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "surrogates",
    "ppm",
    "latent_decontamination",
    "ordinal_toxicity",
    "paragraph_dedup",
    "order_minhash",
    "token_blocks",
    "chat_windows",
    "curriculum",
    "isolation_quality",
    "periodic_runs",
    "line_dedup",
    "token_alignment",
)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in import_module(f"enquira.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in getattr(import_module(f"enquira.llm.{m}"), "ORACLE_SQL", {}).items()}
