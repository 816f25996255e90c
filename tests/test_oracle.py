"""Every query with a SQL twin agrees with DuckDB on the smallest tables; the others run, and are reported as skipped."""

from __future__ import annotations

import os

import pytest

import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(oracle.entry.queries()))
def test_query(spark, name):
    ok, message = oracle.compare(spark, oracle.duck(SF), name, SF)
    if ok is None:
        pytest.skip(message)
    assert ok, message


def test_entry(spark):
    rows = oracle.entry.entry(spark).collect()
    assert len(rows) == 20
