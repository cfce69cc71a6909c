from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from siftworks.session import local_session  # noqa: E402

# started here, so that test modules can use column expressions at the top level
SESSION = local_session(4, 4)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows and a DDL schema to a DataFrame."""

    def make(rows, schema):
        return spark.createDataFrame([tuple(r) if isinstance(r, (list, tuple)) else (r,) for r in rows], schema)

    return make
