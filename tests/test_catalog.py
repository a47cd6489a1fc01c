import pytest

import __spark_entry__ as entry_point
from compare import difference, duck
from lodeseek.catalog.expected import EXPECTED
from lodeseek.catalog.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(EXPECTED)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_no_query_compares_nothing_with_nothing(spark):
    for name in ("lexical_pages", "lexical_crlf"):
        assert QUERIES[name](spark, SF_DIR).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert difference(spark, con, SF_DIR, name) is None


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
