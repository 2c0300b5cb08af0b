"""Every query by name, with the SQL that gives the same rows."""

from __future__ import annotations

from seqloom.plans import binaries, labelling, mining, models

MODULES = (mining, labelling, models, binaries)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
