from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from helpers import SF_SMALL, TABLES  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from shopsight.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8, app="shopsight-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in [*TABLES, "documents"]:  # the document operators' table, for their entries with SQL
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con
