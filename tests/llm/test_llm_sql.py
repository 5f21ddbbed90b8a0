"""Registered queries of the training-data operators against their SQL."""

import pytest
from compare import assert_same, connect

from keyloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name])


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
