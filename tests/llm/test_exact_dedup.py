"""Chunk recipes against SQL and on odd rows; identifiers that are not unique do not join texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitscope.llm import exact_dedup


def test_query_is_sql(spark, data, duck, rows):
    assert rows(exact_dedup.op7_exact(spark, data)) == duck(exact_dedup.SQL, data, "documents")


def test_odd_rows(spark, documents):
    long = "abcdefgh" * 40_000
    docs = documents(
        [(9, None), (8, ""), (7, " \t\n\x0b\x0c\r"), (1, "a b"), (2, "a  b"), (3, "ab"), (4, "a\u00a0b"), (5, "same"), (5, "same"), (6, long), (11, f" {long[:100]} {long[100:]}"), (None, "null"), (12, "null")],
        ids="x", alt="y", norm="z", chunk="c", id="i",
    )
    got = {}
    for r in exact_dedup.exact_groups(docs).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert got[9] == got[8] == [(7, 3, False)] and got[7] == [(7, 3, True)]
    assert got[1] == [(2, 3, False)] and got[2] == [(2, 3, True)] and got[3] == [(2, 3, False)] and got[4] == [(4, 1, True)]
    assert got[5] == [(5, 2, True)] * 2
    assert got[6] == [(11, 2, False)] and got[11] == [(11, 2, True)]
    assert got[12] == [(12, 2, True)] and got[None] == [(12, 2, False)]
    assert exact_dedup.exact_groups(documents([])).count() == 0


def test_ambiguous_identifiers(spark, documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_identifier", lambda chunk: F.length(chunk).cast("long"))
    docs = documents([(1, "abc"), (2, "abd"), (3, "a b c"), (4, "abcd"), (5, "ab d")])
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: 3, 3: 3, 2: 5, 5: 5, 4: 4}


def test_chunks_follow_the_content(spark):
    import random

    rng = random.Random(1)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    df = spark.createDataFrame([(base,), ("inserted" + base,)], "norm string").select(F.regexp_extract_all("norm", F.lit(exact_dedup.CHUNK), F.lit(0)).alias("c"))
    a, b = (r.c for r in df.collect())
    assert "".join(a) == base and "".join(b) == "inserted" + base
    assert len(set(a) & set(b)) > 0.9 * len(a)
