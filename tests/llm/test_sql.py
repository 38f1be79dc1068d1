"""Corpus queries against their SQL."""

import pytest

from tablesmith.llm import queries as Q
from tests import oracle


@pytest.fixture(scope="module")
def db():
    return oracle.connect()


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(spark, db, name):
    assert oracle.compare(spark, db, name, Q.queries()[name], Q.oracle_sql()[name]) == ""
