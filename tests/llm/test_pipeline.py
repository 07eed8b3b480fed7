"""The five stages on whole tables and on odd ones."""

from __future__ import annotations

import corpus_pipeline as p
from commitscope.llm._common import staged


def test_stages_and_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, size = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        out = staged(stage(spark, docs, data))
        assert out.columns == columns, name
        n = out.count()
        assert 0 < n <= size, name
        docs, size = out, n
    packed = p.run(spark, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048


def test_clean_documents_stay_and_copies_go(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    twice = docs.unionByName(docs.selectExpr("doc_id + 100000 doc_id", "text", "lang", "source", "n_chars"))
    out = p.near(spark, twice, data)
    assert out.filter("doc_id >= 100000").count() == 0 and out.count() > 0.5 * docs.count()


def test_odd_tables(spark, data, documents):
    odd = documents([(None, None), (1, ""), (1, "x"), (2, "plain text of words")])
    for docs in (documents([]), odd, documents([(1, "a b")], extra="x")):
        for name, stage in p.STAGES[:-1]:
            out = staged(stage(spark, docs, data))
            assert out.columns == docs.columns, name
        assert p.pack(spark, docs, data).count() == docs.count()


def test_oracle_is_declared():
    assert p.ORACLE_SQL is None and [n for n, _ in p.STAGES] == ["language", "quality", "lines", "near", "packing"]


def test_line_and_near_stages_are_brute_force_on_the_whole_table(spark, data):
    """Which lines and which documents stay, against comparing all pairs of runs and of shingle sets."""
    from test_line_dedup import brute, expected

    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    gone = brute(rows)
    texts = {d: expected(t, gone[k]) for k, (d, t) in enumerate(rows)}
    texts = {d: t for (d, t0), t in zip(rows, texts.values(), strict=True) if not (t == "" and t0)}
    out = staged(p.lines(spark, docs, data))
    assert {r.doc_id: r.text for r in out.collect()} == texts

    def shingles(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    ids = sorted(texts)
    sets = [shingles(texts[d]) for d in ids]
    up = list(range(len(ids)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(ids)):
        for j in range(i):
            if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = {ids[i] for i in range(len(ids)) if root(i) == i}
    assert {r.doc_id for r in p.near(spark, out, data).collect()} == want and len(want) < len(ids)


def test_run_leaves_one_folder_a_stage(spark, data):
    from commitscope.llm import _common

    before = len(_common._made)
    p.run(spark, data)
    assert len(_common._made) - before == len(p.STAGES)
