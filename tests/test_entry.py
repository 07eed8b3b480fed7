"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as e


def test_contract(spark):
    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.count() > 0 and "bus_factor" in df.columns
