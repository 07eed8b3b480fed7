"""Rule statistics against brute force; the forest isolates what is odd and keeps what is not."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

from commitscope.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


ODD = ["", " \n\t", "a b a b a b a b", "x\nx\n x\n\nx", "#$ %% <b>", "é ü 漢字 🙂", "a\u00a0b c\u2003d", "one two three", "\n".join(["w w w"] * 30)]


def test_statistics():
    for text in ODD:
        assert quality.statistics(text.encode())[:5] == brute(text), text


def test_query(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = quality.op10_quality(spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_labelled_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in quality.op10_quality(spark, "/root/testdata/sf0.01").collect() if not r.base_failed and r.doc_id in labels]
    good = [r.kept for r in got if labels[r.doc_id] == 1]
    assert sum(good) >= 0.98 * len(good)
    bad = [r.kept for r in got if labels[r.doc_id] == 0]
    assert len(bad) > 10 and sum(bad) <= 0.1 * len(bad)


def slow_path(tree, row):
    """Path length of one row, node by node."""
    feature, split, child, path = tree
    at = 0
    while feature[at] >= 0:
        at = child[at] + int(row[feature[at]] > split[at])
    return path[at]


def test_scores_are_mean_path_lengths_and_the_verdict_follows(spark):
    rows = quality.op10_quality(spark, "/root/testdata/sf0.01").collect()
    stats = spark.createDataFrame([tuple(r[c] for c in ("doc_id", *quality.STATS)) for r in rows], "doc_id long, " + ", ".join(f"{c} long" for c in quality.STATS))
    forest, threshold = quality.fit(stats, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    for r in rows[::7]:
        x = quality.features(np.array([[r[c] for c in quality.STATS]], np.int64))[0]
        score = 2 ** (-sum(slow_path(t, x) for t in forest.trees) / len(forest.trees) / forest.norm)
        assert abs(score - r.score) < 1e-9 and r.kept == (not r.base_failed and r.score < threshold)


def test_paths_never_exceed_the_depth_and_leaves_hold_all_rows():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 3))
    forest = quality.Forest(rows, np.full(3, -9.0), np.full(3, 9.0))
    for feature, _, _, path in forest.trees[:5]:
        assert path[feature < 0].max() <= 8 + quality.DEEPER + forest.norm and path[feature < 0].min() >= 1


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2000, 4))
    forest = quality.Forest(rows, np.full(4, -15.0), np.full(4, 15.0))
    odd = np.vstack([rows[:500], rng.normal(size=(20, 4)) + 12])
    score = forest.score(odd)
    assert score[500:].min() > score[:500].max()
    assert np.array_equal(quality.Forest(rows, np.full(4, -15.0), np.full(4, 15.0)).score(odd), score)
    assert quality.Forest(rows[:0]).score(odd).tolist() == [0.0] * len(odd)


def plain(k):
    return " ".join(f"word{(k * 31 + j * j) % 997}x" for j in range(120))


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (3, plain(3)), (3, plain(3)), (None, plain(4)), (5, "again and again " * 60), (6, " ".join(f"w{k}" for k in range(100_000)))], n_words="x", kept="y", quality="q", good="g")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 0), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == 7
    assert {(r.doc_id, r.base_failed) for r in got} == {(1, True), (2, True), (3, False), (None, False), (5, True), (6, False)}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(str(r.doc_id) for r in quality.keep_good(docs, empty).collect()) == ["3", "3", "6", "None"]
    assert quality.judged(documents([]), labels).count() == 0 and quality.keep_good(documents([]), empty).count() == 0
