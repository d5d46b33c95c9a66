"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools.check import compare, connect  # noqa: E402
from wirelens.catalog import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    status, n, _, _, note = compare(spark, con, name, sf)
    assert status in ("ok", "rows"), note
    assert n > 0 or name in ("lesson_match_long_text",)
    if name not in ORACLES:
        assert status == "rows"
