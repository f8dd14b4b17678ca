"""Every operator with an SQL equivalent matches DuckDB on the sf0.001 tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from compare import digest, duck_frame, spark_frame
from helpers import SF_SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "gross_revenue" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    got = spark_frame(QUERIES[name](spark, SF_SMALL))
    want = duck_frame(duck, ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert digest(got) == digest(want)
