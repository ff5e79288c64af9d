"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from gaugeframe.queries.registry import all_queries
from tests.oracle import DATA, compare, connect

SF_DIR = DATA.format(sf="0.001")
QUERIES = {name: fn for name, (fn, _) in all_queries().items()}
ORACLE = {name: sql for name, (_, sql) in all_queries().items() if sql}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    status, detail, _ = compare(spark, con, SF_DIR, QUERIES[name], ORACLE.get(name))
    assert status != "FAIL", detail


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 1


def test_few_queries_lack_sql():
    assert set(QUERIES) == set(ORACLE)
