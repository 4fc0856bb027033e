"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import os
import sys

import pytest

from conftest import SF_DIR

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles as check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


@pytest.fixture(scope="module")
def con():
    connection = check.connect(SF_DIR)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    outcome = check.compare(spark, con, SF_DIR, name)
    assert outcome.startswith(("ok", "rows-only")), outcome
    assert not outcome.endswith(" 0") or name in {"d13_missing_months"}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
