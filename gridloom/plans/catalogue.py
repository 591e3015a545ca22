"""The queries over the test tables, each with its equivalent SQL where there is one."""

from __future__ import annotations

from . import axis, images, jobs, rules, scoring, sources, streams, strokes, tables, text  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
