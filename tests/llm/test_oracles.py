"""The queries that SQL can express, against the other engine."""

import pytest

from terrazo.llm.queries import ORACLE_SQL, QUERIES

from ..compare import duck, same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_oracle(spark, sf, name):
    assert same(QUERIES[name](spark, sf), duck(sf), ORACLE_SQL[name]) == ""
