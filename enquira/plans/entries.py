"""A registry that operator modules fill: name, callable and check SQL."""

from __future__ import annotations

from collections.abc import Callable

from .adapters import check_sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def exact_counts(sql: str) -> str:
    """count_if(x) as count over x, which is a plain 64-bit count in DuckDB."""
    mark = "count_if("
    while (at := sql.find(mark)) >= 0:
        depth, end = 1, at + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(nullif({sql[at + len(mark) : end - 1]}, false)){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a callable (spark, sf_dir) -> DataFrame, with DuckDB SQL over the views."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = exact_counts(check_sql(sql, *views))
        return f

    return add
