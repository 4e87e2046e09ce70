"""Every query against the other engine on the small data."""

import pytest

from terrazo.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

from .compare import duck, same


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_oracle(spark, sf, con, name):
    assert same(QUERIES[name](spark, sf), con, ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in ORACLE_SQL
