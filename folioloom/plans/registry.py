"""Core queries by name, and their SQL."""

from __future__ import annotations

from folioloom.plans.queries import REGISTRY, Query
from folioloom.plans.sql import SQL


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
