"""All registered queries of the gridded operators."""

from __future__ import annotations

from gridloom.plans import climate, files, models, registry, tables, terrain

#: Imported for their registrations.
MODULES = (climate, files, models, tables, terrain)


def queries() -> dict:
    return dict(sorted(registry.QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(registry.SQL.items()))
