"""Language mixtures: held-out accuracy, mixtures of known parts, and inputs that must not matter."""

from __future__ import annotations

import zlib

import numpy as np

from commitscope.llm import langid


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = langid.op3_langid(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    hit = total = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        lang, text = docs[r.doc_id].lang, docs[r.doc_id].text
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.held_out and lang is not None and r.lang_pred != "und":
            total += 1
            hit += r.lang_pred == lang
    assert total > 100 and hit >= 0.95 * total


def test_predictions_use_the_text_alone(spark, documents):
    rows = [(k, t) for k, t in enumerate(["the cat and the dog of the house"] * 40)]
    docs = documents(rows)
    other = docs.selectExpr("doc_id", "text", "lang", "'elsewhere' source", "n_chars")
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(other).collect()}


def make_model(spark, texts):
    rows = spark.createDataFrame([(lang, t) for lang, ts in texts.items() for t in ts], "lang string, text string")
    return langid.learn(rows)


def test_mixture_finds_both_parts(spark):
    a = [" ".join(w for w in "the and of that with there then other these this those they their".split()) * 20]
    b = [" ".join(w for w in "der die das und nicht eine einer über schön zwischen welche werden".split()) * 20]
    names, model = make_model(spark, {"aa": a, "bb": b})
    assert names == ["aa", "bb"]
    found, _ = langid.mixture("the and of that with there " * 30 + "der die das und nicht eine " * 10, model)
    assert set(found) == {0, 1} and abs(found[0] - 0.75) < 0.1
    assert set(langid.mixture("the and of that with there " * 30, model)[0]) == {0}
    assert langid.mixture("1234 !!! \n", model)[0] == {} == langid.mixture("", model)[0]


def test_a_small_share_is_judged_by_its_penalty_alone(spark):
    a = [" ".join(w for w in "the and of that with there then other these this those they their".split()) * 20]
    b = [" ".join(w for w in "der die das und nicht eine einer über schön zwischen welche werden".split()) * 20]
    _, model = make_model(spark, {"aa": a, "bb": b})
    found, _ = langid.mixture("the and of that with there then other " * 120 + "zwischen welche werden einer nicht über schön " * 2, model)
    assert set(found) == {0, 1} and found[1] < 0.02


def test_unlearned_text_is_told(spark, documents):
    import random

    rng = random.Random(2)
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r.text and len(r.text) > 300}
    names, model = langid.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("lang", "text").filter("text is not null"))
    known = [langid.mixture(r.text, model)[1] for r in docs.values() if r.lang is not None]
    assert np.mean(np.array(known) < 0.5) > 0.97
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(150))
    other = "быстрая коричневая лиса прыгает через ленивую собаку " * 20
    assert langid.mixture(noise, model)[1] > 0.8 and langid.mixture(other, model)[1] > 0.8


def test_nothing_to_learn_from(spark, documents):
    docs = documents([(1, "text"), (2, None), (3, "123"), (None, "x")], lang_pred="p", score="s", held_out="h").drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect()} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (None, "und", 0.0)}
    assert langid.identify(documents([])).count() == 0
    assert langid.keep_identified(documents([])).count() == 0


def test_stage_keeps_rows_as_they_are(spark, documents):
    docs = documents([(1, "some plain words in a text " * 20), (1, None), (2, "..."), (4, "more plain words " * 50_000)], identified="x")
    kept = langid.keep_identified(docs)
    assert langid.identify(docs).columns == ["doc_id", "held_out", "lang_pred", "score", "langs", "unknown"]
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_counts_are_of_all_rows(spark):
    _, one = make_model(spark, {"a": ["abc"], "b": ["xyz"]})
    _, two = make_model(spark, {"a": ["abc"], "b": ["xyz"] * 500})
    assert not np.array_equal(one, two)
