"""Fixtures of the corpus operators' tests."""

from __future__ import annotations

import duckdb
import pytest


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text) pairs, with a language, a source and its size."""

    def build(rows, **extra):
        fields = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {k} string" for k in extra)
        full = [(i, t, "en", "web", None if t is None else len(t), *extra.values()) for i, t in rows]
        return spark.createDataFrame(full, fields)

    return build


@pytest.fixture
def duck():
    """Rows of DuckDB SQL over tables of a folder, as sorted tuples with columns by name."""

    def run(sql, data, *tables):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=repr)

    return run


@pytest.fixture
def rows():
    def run(df):
        names = sorted(df.columns)
        return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)

    return run
