"""Every catalogue query against its SQL."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "None"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        return repr(round(float(v), 6))
    except (TypeError, ValueError):
        return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(plain, r)) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(SQL) if not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert {r.key for r in entry.entry(spark).collect()} == {"temp", "day", "note", "flag"}
