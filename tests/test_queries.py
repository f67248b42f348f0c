"""Every registered query against its SQL check, on whole tables."""

import pytest
from checker import compare, engine

import __spark_entry__ as entry

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return engine(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, folder, name):
    if name in CHECKS:
        assert compare(spark, con, QUERIES[name], CHECKS[name], folder) is None
    else:
        assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
