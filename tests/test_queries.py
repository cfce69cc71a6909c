"""Every registered query against its checking SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import check_queries
import pytest

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(check_queries.entry.queries()))
def test_query(spark, con, name):
    difference = check_queries.compare(spark, con, SF_DIR, name)
    assert difference is None or difference.startswith("rows only"), difference


def test_catalogue():
    queries, oracles = check_queries.entry.queries(), check_queries.entry.oracle_sql()
    assert set(oracles) <= set(queries)
    # those of the optional subpackage that SQL cannot express are tested there
    assert all(name == "pipeline" or name.startswith("op") for name in set(queries) - set(oracles))


def test_entry(spark):
    assert check_queries.entry.entry(spark).count() > 0
