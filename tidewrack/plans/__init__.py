"""The registered queries and their SQL: registry has the core, extended the rest."""

from __future__ import annotations


def queries() -> dict:
    from tidewrack.plans import extended, registry  # noqa: F401  extended adds its own to the registry

    return registry.queries()


def oracle_sql() -> dict:
    from tidewrack.plans import extended, registry  # noqa: F401

    return registry.oracle_sql()
