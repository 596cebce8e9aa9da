from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tallyspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture
def ledger(spark):
    """Build a raw text ledger from (date, description, amount, type, category, account) rows."""

    def make(rows, entity=None):
        cols = ["Date", "Description", "Amount", "Transaction Type", "Category", "Account Name"]
        schema = ", ".join(f"`{c}` string" for c in cols)
        if entity is None:
            return spark.createDataFrame(rows, schema)
        return spark.createDataFrame([(entity, *r) for r in rows], "entity string, " + schema)

    return make
