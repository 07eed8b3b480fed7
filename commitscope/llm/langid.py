"""Language identification by multilingual mixture inference.

Learning: letter n-grams (orders 1 to 3, words padded with a space, hashed to ``BUCKETS`` slots an order) are counted
per language over every training row. Prediction: a text is a bag of words drawn from a mixture of languages.
Expectation-maximisation estimates the proportions from the words' n-gram likelihoods; the language set grows greedily
from the best single language and a language joins only if it raises the likelihood by more than its penalty
(``PENALTY * ln(words)``). The log-likelihood is concave in the proportions, so its slope at the present mixture bounds
what a language can add; one that cannot reach its penalty is not tried, which changes no result. The dominant language
of the chosen set is the prediction, its proportion the score.

A component for what was not learned (letters of all languages in any order, or of none) is judged by the same penalty
after the languages; its proportion tells words of no learned language, such as random letters or another script.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm._common import load, private, utf8

BUCKETS, ORDERS, ROUNDS, PENALTY, SMOOTH = 1 << 14, 3, 12, 3.0, 0.5
#: Bound of the model's size (512 languages are 100 MB): more distinct values of ``lang`` are an error, none is left out.
MOST_LANGUAGES = 512
#: Log-probability of a border between words in the component of unlearned text.
_BORDER = float(np.log(0.18))
WEIGHTS = (0.2, 0.3, 0.5)
_MULT = np.array([2654435761, 2246822519, 3266489917], np.uint64)


@cache
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 32 where it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _buckets(mixed: np.ndarray) -> np.ndarray:
    mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(50)).astype(np.int64) % BUCKETS


def words_grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-gram ids, shape (ORDERS, letters), the first letter of each word, and each letter's neighbours.

    Neighbours: one-letter ids of the letter before, the letter and the letter after; -1 for a border.
    """
    at = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[at]
    c = np.concatenate([[32], c, [32]]).astype(np.uint64)
    letter = c != 32
    i = np.flatnonzero(letter)
    if not len(i):
        return np.zeros((ORDERS, 0), np.int64), i, np.zeros((3, 0), np.int64)
    one, two, three = c[i] * _MULT[0], c[i - 1] * _MULT[1], c[i + 1] * _MULT[2]
    mixed = np.stack([one, one ^ (two << np.uint64(7)), one ^ (two << np.uint64(7)) ^ (three << np.uint64(13))])
    ids = _buckets(mixed) + np.arange(ORDERS)[:, None] * BUCKETS
    single = np.full(len(c), -1)
    single[i] = ids[0]
    return ids, np.flatnonzero(~letter[i - 1]), np.stack([single[i - 1], ids[0], single[i + 1]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids, _, _ = words_grams(text)
            if lang not in total:
                total[lang] = np.zeros(ORDERS * BUCKETS, np.int64)
            total[lang] += np.bincount(ids.ravel(), minlength=ORDERS * BUCKETS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "gram", "n"])


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """``rows(lang, text)``, all of them -> language names in order and log-probabilities (languages x grams).

    The last row is of the letters of all languages, for the component of unlearned text. The driver receives at most
    languages x ORDERS x BUCKETS sums, whatever the number of rows.
    """
    sums = rows.filter("lang is not null").mapInArrow(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} distinct languages; at most {MOST_LANGUAGES} can be learned")
    counts = np.zeros((len(names), ORDERS * BUCKETS))
    index = {x: k for k, x in enumerate(names)}
    if names:
        counts[np.array([index[x] for x in got.column("lang").to_pylist()]), got.column("gram").to_numpy()] = got.column("n").to_numpy()
    per_order = counts.reshape(len(names), ORDERS, BUCKETS)
    prob = (per_order + SMOOTH) / (per_order.sum(axis=2, keepdims=True) + SMOOTH * BUCKETS)
    pooled = np.zeros(ORDERS * BUCKETS)
    letters = per_order[:, 0].sum(axis=0) + SMOOTH
    pooled[:BUCKETS] = np.log(letters / letters.sum())
    return names, np.vstack([np.log(prob).reshape(len(names), ORDERS * BUCKETS), pooled]).astype(np.float32)


def _em(like: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mixture proportions and the words' likelihoods under them, for word likelihoods (components x words)."""
    pi = np.full(len(like), 1 / len(like))
    for _ in range(rounds):
        joint = like * pi[:, None]
        pi = (joint / joint.sum(axis=0)).mean(axis=1)
    return pi, pi @ like


def mixture(text: str, model: np.ndarray) -> tuple[dict[int, float], float]:
    """Language index -> proportion for the chosen set, and the share of unlearned text.

    Proportions are among the languages. Empty if the text has no letters or nothing was learned.
    """
    ids, starts, near = words_grams(text)
    n = len(starts)
    if not n or len(model) < 2:
        return {}, 1.0
    score = np.zeros((len(model), ids.shape[1]), np.float32)
    for order, weight in enumerate(WEIGHTS):
        score[:-1] += weight * model[:-1, ids[order]]
    # unlearned text: its letters in any order, or any gram at all
    before, own, after = np.where(near >= 0, model[-1, near], _BORDER)
    score[-1] = WEIGHTS[0] * own + WEIGHTS[1] * np.maximum(own + before, -np.log(BUCKETS)) + WEIGHTS[2] * np.maximum(before + own + after, -np.log(BUCKETS))
    log = np.add.reduceat(score, starts, axis=1).astype(np.float64)
    log -= log.max(axis=0)
    like = np.exp(np.maximum(log, -60))
    best = int(log[:-1].sum(axis=1).argmax())
    penalty = PENALTY * np.log(n + 1)
    chosen, shares, mixed = [best], np.ones(1), like[best]

    def joined(k: int) -> bool:
        """Adds component k if that pays."""
        nonlocal chosen, shares, mixed
        new, words = _em(like[[*chosen, k]])
        if np.log(words / mixed).sum() <= penalty:
            return False
        chosen, shares, mixed = [*chosen, k], new, words
        return True

    left = [k for k in range(len(model) - 1) if k != best]
    while left:
        slope = (like[left] / mixed).sum(axis=1) - n
        k = int(slope.argmax())
        if slope[k] <= penalty:
            break
        joined(left.pop(k))
    unknown = float(shares[-1]) if (like[-1] / mixed).sum() - n > penalty and joined(len(model) - 1) else 0.0
    found = {k: float(x) for k, x in zip(chosen, shares, strict=True) if k < len(model) - 1}
    total = sum(found.values())
    return {k: x / total if total else 1 / len(found) for k, x in found.items()}, unknown


def _predict(names: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lang, score, langs, unknown = [], [], [], []
            for text in batch.column("text").to_pylist():
                found, other = mixture(text, model)
                top = max(found, key=lambda k: (found[k], -k)) if found else -1
                lang.append(names[top] if found else "und")
                score.append(min(1.0, max(0.0, found.get(top, 0.0))))
                langs.append(",".join(names[k] for k in sorted(found, key=lambda k: -found[k])))
                unknown.append(other)
            kept = [c for c in batch.schema.names if c != "text"]
            made = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.string()), pa.array(unknown, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "lang_pred", "score", "langs", "unknown"])

    return run


def held_out(id_col: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, langs, unknown)``, one row for every row of ``docs``.

    Learned from rows with a language that are not held out. Null texts and texts without letters are ``und`` with
    score 0, as is every text if nothing could be learned; ``unknown`` is the share of unlearned text beside the languages. Repeated rows each give a row; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names, model = learn(docs.filter(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 49,152 floats
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text.alias("text"))
    return slim.mapInArrow(_predict(names, shared), "doc_id long, held_out boolean, lang_pred string, score double, langs string, unknown double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.35) -> DataFrame:
    """``docs`` without rows whose language is ``und`` or whose dominant language has less than ``least`` of the words.

    Words of unlearned text count as words: text that is mostly of no learned language goes.

    The verdict is computed beside the row, so repeated ids cannot mix; all columns pass unchanged.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names, model = learn(docs.filter(~held_out(id_col)).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    mark = private(docs, "identified")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x in batch.column(text_col).to_pylist():
                found, other = mixture(str(x or ""), shared.value)
                ok.append(bool(found) and max(found.values()) * (1 - other) >= least)
            yield batch.append_column(mark, pa.array(ok, pa.bool_())).filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.withColumn(mark, F.lit(True)).schema).drop(mark)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and langs, the chosen set, and unknown) for every document."""
    return identify(load(spark, sf_dir, "documents"))
