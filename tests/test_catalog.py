"""Every registered query against its SQL twin, over the whole tables of the smallest scale."""

import pytest

import __spark_entry__ as entry
from oracle import assert_same, connect
from sparkscope import catalog

catalog.load()

QUERIES, SQL = dict(catalog.QUERIES), dict(catalog.SQL)


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_names():
    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["service_name", "hour"]
    assert df.count() > 0
