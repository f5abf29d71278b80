"""All core queries by name, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

#: The query that the driver's smoke check runs.
FLAGSHIP = "q8_popular_unseen"

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, and its DuckDB SQL where there is one."""

    def add(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    from larkspur.plans import composites, data, models, more, opsq, ranking, sampling  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _ORACLES
