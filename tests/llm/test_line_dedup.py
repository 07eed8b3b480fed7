"""Line runs against a search over all pairs of runs."""

from __future__ import annotations

import random

import pytest

from commitscope.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def brute(docs, min_words=line_dedup.MIN_WORDS):
    """docs: (doc_id, text) in order of doc_id -> {doc index: set of deleted line numbers}."""
    flat, gone = [], {k: set() for k in range(len(docs))}
    for k, (_, text) in enumerate(docs):
        for j, raw in enumerate((text or "").split("\n")):
            if t := raw.strip(SPACE):
                flat.append((k, j, t, len(t.split())))
    for q in range(len(flat)):
        for p in range(q):
            m = words = 0
            while q + m < len(flat) and flat[q + m][0] == flat[q][0] and flat[p + m][0] == flat[p][0] and flat[p + m][2] == flat[q + m][2]:
                words += flat[q + m][3]
                m += 1
            if words >= min_words:
                gone[flat[q][0]] |= {flat[q + i][1] for i in range(m)}
    return gone


def expected(text, gone):
    if text is None or not gone:
        return text
    left = "\n".join(x for j, x in enumerate(text.split("\n")) if j not in gone)
    return left if left.strip(SPACE) else ""


@pytest.mark.parametrize("seed", range(4))
def test_random_runs(spark, documents, seed):
    rng = random.Random(seed)
    lines = ["a", "b b", "c c c", "d d d d", "e e e e e", "f f f f f f", "", "  ", " a "]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14)))) for k in range(30)]
    want = brute(docs)
    got = {r.doc_id: r for r in line_dedup.line_dedup(documents(docs)).collect()}
    for k, text in docs:
        assert got[k].text == expected(text, want[k]), (k, text)
        assert got[k].lines_deleted == len(want[k])


def test_query_is_brute_force_on_whole_tables(spark, data):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    want = brute(docs)
    got = {r.doc_id: r for r in line_dedup.op9_lines(spark, data).collect()}
    assert len(got) == len(docs) and any(want.values())
    for k, (doc, text) in enumerate(docs):
        assert got[doc].text == expected(text, want[k])


def test_a_run_of_short_lines_is_one_passage(spark, documents):
    run = "one two\nthree\nfour five\n\nsix"
    docs = [(1, f"start\n{run}\nend"), (2, f"other\n{run}\nlast"), (3, "one two\nthree")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(documents(docs)).collect()}
    assert got[1] == docs[0][1] and got[3] == docs[2][1]
    assert got[2] == "other\n\nlast"


def test_odd_rows(spark, documents):
    line = "these are five plain words"
    docs = documents([(2, None), (2, ""), (3, " \n\n"), (5, line), (5, line), (None, line), (4, f" {line}\t\r\nshort")], row="r", line="l", a="a", deleted="d", row_number="n", lines_deleted="x", emptied="y")
    out = line_dedup.line_dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-2:] == ["lines_deleted_", "emptied_"]
    got = sorted(((r.doc_id, r.text, r.lines_deleted_, r.emptied_) for r in out.collect()), key=str)
    assert got == sorted([(2, None, 0, False), (2, "", 0, False), (3, " \n\n", 0, False), (4, f" {line}\t\r\nshort", 0, False), (5, "", 1, True), (5, "", 1, True), (None, "", 1, True)], key=str)
    assert line_dedup.line_dedup(documents([])).count() == 0


def test_long_texts(spark, documents):
    line = "a line of rather many words that repeats"
    docs = documents([(1, "\n".join([line] * 20_000)), (2, "\n".join(f"own line number {k} of this text" for k in range(20_000)))])
    got = {r.doc_id: (r.lines_deleted, r.text) for r in line_dedup.line_dedup(docs).collect()}
    assert got[1] == (19_999, line) and got[2][0] == 0


def test_rows_dealt_anew_and_a_wide_extra_column(spark, documents):
    """The result does not depend on how the input's tasks are formed when it is read twice."""
    rng = random.Random(9)
    lines = [f"line {k} of some words here" for k in range(12)]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    want = brute(docs)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    try:
        wide = documents(docs).selectExpr("*", "repeat(text, 40) wide").repartition(16, "doc_id")
        got = {r.doc_id: r.text for r in line_dedup.line_dedup(wide).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")
    assert got == {k: expected(text, want[k]) for k, text in docs}


def test_doubling_converges(spark, documents):
    """Intervals of every depth up to the longest repeated run, each with its earliest suffix."""
    run = [f"line {k}" for k in range(21)]
    docs = documents([(1, "\n".join(run)), (2, "\n".join(["x", *run, "y"])), (3, "\n".join(run[:9]))], row="r")
    found = line_dedup.staged(line_dedup.lines(docs.selectExpr("*", "doc_id as n"), "n"))
    levels = line_dedup.intervals(found)
    assert len(levels) == 5  # 1, 2, 4, 8 and 16 lines
    for k, level in enumerate(levels):
        rows = [(r.pos.d, r.at, r.first.d, r.first.at) for r in level.collect()]
        m = 1 << k
        want = [(d, at, 1, at - (d == 2)) for d, low, n in ((1, 0, 21), (2, 1, 21), (3, 0, 9)) for at in range(low, low + n - m + 1)]
        assert sorted(rows) == sorted(want)


@pytest.mark.parametrize("least", [1, 2, 9, 40])
def test_other_lengths(spark, documents, least):
    rng = random.Random(least)
    lines = ["a", "b b", "c c c", "d d d d"]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for k in range(12)]
    docs += [(k + 20, text) for k, text in docs] + [(50, "\n".join("a" for _ in range(90)))]
    want = brute(docs, least)
    got = {r.doc_id: r for r in line_dedup.line_dedup(documents(docs), min_words=least).collect()}
    for k, (doc, text) in enumerate(docs):
        assert got[doc].text == expected(text, want[k])


def test_query_is_sql(spark, data, duck, rows):
    assert rows(line_dedup.op9_lines(spark, data)) == duck(line_dedup.SQL, data, "documents")
