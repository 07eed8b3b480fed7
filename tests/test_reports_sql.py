"""Every registered report against its SQL, over whole tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from commitscope.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_report_is_its_sql(spark, data, duck, name):
    got = QUERIES[name](spark, data)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = rows_of(names, found.fetchall())
    assert rows_of(got.columns, got.collect()) == want


def test_every_report_has_sql():
    assert QUERIES.keys() == SQL.keys()
