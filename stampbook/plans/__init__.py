"""Registered queries: registry operators bound to the given tables, each with its SQL check."""

from importlib import import_module


def load():
    """(queries by name, SQL checks by name)."""
    for module in ("catalogue", "pages", "changes"):
        import_module(f"stampbook.plans.{module}")
    from stampbook.plans.registry import CHECKS, QUERIES

    return QUERIES, CHECKS
