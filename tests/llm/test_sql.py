"""The operators' queries against DuckDB SQL, where it can express them."""

from __future__ import annotations

import pytest
from oracle import compare, duck

from sparkloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE_SQL[name]) is None


def test_other_queries_have_rows(spark, sf_dir):
    for name in sorted(set(QUERIES) - set(ORACLE_SQL)):
        assert QUERIES[name](spark, sf_dir).limit(3).count() == 3
