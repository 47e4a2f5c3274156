"""Every registered query and its SQL, by module."""

from __future__ import annotations

MODULES = ["q_search", "q_records", "q_formats", "q_imports", "q_identify", "q_library"]


def _all(name: str) -> dict:
    from importlib import import_module

    out: dict = {}
    for module in MODULES:
        out |= getattr(import_module(f"quillstack.plans.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
