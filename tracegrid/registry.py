"""All queries of the engine, by the name of the operator they show, and the SQL that says the same."""

from __future__ import annotations

from .plans import relational, scoring

_PLANS = [relational, scoring]


def queries() -> dict:
    return {k: v for plan in _PLANS for k, v in plan.query.queries.items()}


def oracle_sql() -> dict:
    return {k: v for plan in _PLANS for k, v in plan.query.sql.items()}
