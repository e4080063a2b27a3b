"""All registered queries of the library and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: `name` runs the function; `sql` is the same query for DuckDB."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict:
    _load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return ORACLES


def _load() -> None:
    from . import exchange, joins, models, scans, scores, series  # noqa: F401  they register themselves
