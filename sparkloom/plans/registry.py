"""The library's queries and their oracle SQL, by name."""

from __future__ import annotations

QUERIES = {}
ORACLE_SQL = {}


def query(name: str, sql: str | None = None):
    """Registers a query under ``name`` and the SQL that it must agree with."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


from sparkloom.plans import aggregates, changes, dialect, evaluation, joins, profiles, retrieval, schema, schema_rank, selections, windows  # noqa: E402, F401
