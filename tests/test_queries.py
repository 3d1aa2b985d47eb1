"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tagweave.workload import registry
from tagweave.workload.check import connect, differences

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert registry.QUERIES.items() <= entry.queries().items() and registry.SQL.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, tables, name):
    assert differences(registry.QUERIES[name](spark, FOLDER), tables, registry.SQL[name]) == []


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["dataset", "image", "caption", "tags"] and frame.take(1)
