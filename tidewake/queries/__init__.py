"""Registered queries and their DuckDB SQL, by the inventory's ids."""

from __future__ import annotations

from collections.abc import Callable

from ..session import STREAM_SQL

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, stream: bool = True) -> Callable:
    """Register a (spark, sf_dir) function; ``sql`` may use the stream view as ``s``."""

    def keep(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = f"WITH {STREAM_SQL} {sql}" if stream and not sql.lstrip().startswith(",") else f"WITH {STREAM_SQL}{sql}" if stream else sql
        return run

    return keep


from . import aggregates, estimators, evaluation, joins, machines, pipelines, scalars, sources, timed, training, updates, windows  # noqa: E402, F401
