"""Every registered query against its SQL statement at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracle import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), SF, ORACLE[name]) is None


def test_entry_has_rows(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "escalate" in out.columns


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
