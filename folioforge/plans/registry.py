"""All queries over the driver tables, with their DuckDB twins."""

from __future__ import annotations

from folioforge.plans import catalogue, logs, structure, windows

_ALL = {k: v for m in (structure, windows, catalogue, logs) for k, v in m.QUERIES.items()}


def queries() -> dict:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {k: s for k, (_, s) in _ALL.items() if s}
