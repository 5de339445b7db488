"""Named queries over the driver tables, each with SQL for an independent check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "context_target_balance"

_queries: dict[str, Callable] = {}
_oracle: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with its SQL."""

    def add(f):
        _queries[name] = f
        if sql is not None:
            _oracle[name] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    _load()
    _names()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _oracle


def _load() -> None:
    from palimpsest.plans import experiments, reports, revisions  # noqa: F401


def _names() -> None:
    for name, f in _queries.items():
        f.__name__ = f.__qualname__ = name
