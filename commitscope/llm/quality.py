"""Quality rules with an isolation forest over rule statistics.

Rule statistics are counted over whole texts. An isolation forest is grown on a bounded sample of labelled good rows
(``FIT_ROWS`` rows in the order of a hash of their ids): trees split random statistics at random values of the box that
all labelled rows, good and bad, span, and a document is anomalous if few splits part it from the sampled rows: its
score follows from its mean path length. The threshold is calibrated on all labelled rows: of the thresholds that
reject at most ``MAX_GOOD_LOST`` of the good rows, the one that best separates good from bad.
Statistics enter the forest as logarithms of ratios, so length alone is no anomaly and small rates are told apart.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm._common import load, private, staged, utf8

FIT_ROWS, TREES, TREE_ROWS, SEED, BINS, MAX_GOOD_LOST = 8_192, 100, 256, 7, 2_000, 0.002
#: Depth of trees beyond the logarithm of their rows (splits of a box often have all rows on one side), and least ratio.
DEEPER, LEAST = 4, 0.02
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_MARKS = b"!?;:.,\"'()[]{}-_=+/\\@~^`"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")


def statistics(text: bytes) -> tuple[int, ...]:
    """STATS of one UTF-8 text; all 0 without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(STATS)
    solid = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    repeated = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        counts = Counter(windows)
        if len(counts) < len(windows):
            hit = np.fromiter((counts[w] > 1 for w in windows), bool, n - 2)
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : k + n - 2] |= hit
            repeated = int(cover.sum())

    def of(chars: bytes) -> int:
        return len(solid) - len(solid.translate(None, chars))

    return (n, len(solid.decode("utf-8", "replace")), of(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), of(_UPPER), of(_MARKS), of(b"0123456789"))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(x) for x in batch.column("text").to_pylist()], np.int64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(rows[:, k]) for k in range(len(STATS)))], names=["doc_id", *STATS])


def features(stats: np.ndarray) -> np.ndarray:
    """Logarithms of ratios of the statistics (rows x STATS) that do not depend on length."""
    n, chars, symbols, dup, repeat, lines, upper, marks, digits = np.maximum(stats, 0).astype(float).T
    w, c = np.maximum(n, 1), np.maximum(chars, 1)
    return np.log(LEAST + np.stack([chars / w, symbols / w, dup / np.maximum(lines, 1), repeat / w, upper / c, marks / w, digits / c], axis=1))


class Forest:
    """Isolation trees as flat arrays: feature (-1 at leaves), split, left child (right is next), expected path length.

    Splits are uniform in the box ``low``-``high`` (that of the rows, if not given) as it is cut on the way down.
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None, trees: int = TREES, size: int = TREE_ROWS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.norm = self._average(min(size, len(rows)))
        self.trees = []
        if len(rows):
            box = rows.min(axis=0) if low is None else low, rows.max(axis=0) if high is None else high
            self.trees = [self._grow(rows[rng.choice(len(rows), min(size, len(rows)), replace=False)], box, rng) for _ in range(trees)]

    @staticmethod
    def _average(n: int) -> float:
        """Path length of an unsuccessful search among n rows: what a leaf of n rows would still take."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, box: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(2, len(rows))))) + DEEPER
        feature, split, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, 0, *box)]
        while todo:
            at, mine, depth, low, high = todo.pop()
            wide = np.flatnonzero(high > low)
            if depth >= limit or not len(mine) or not len(wide):
                path[at] = depth + self._average(len(mine))
                continue
            f = int(rng.choice(wide))
            x = rng.uniform(low[f], high[f])
            feature[at], split[at], child[at] = f, x, len(feature)
            below = mine[:, f] <= x
            for part, a, b in ((mine[below], low, np.where(np.arange(len(high)) == f, x, high)), (mine[~below], np.where(np.arange(len(low)) == f, x, low), high)):
                todo.append((len(feature), part, depth + 1, a, b))
                feature.append(-1), split.append(0.0), child.append(0), path.append(0.0)
        return np.array(feature), np.array(split), np.array(child), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score of feature rows, 0 to 1: two to the power of minus the mean path length over its expectation."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, split, child, path in self.trees:
            at, inner = np.zeros(len(rows), np.int64), np.arange(len(rows))
            while len(inner := inner[feature[at[inner]] >= 0]):
                here = at[inner]
                at[inner] = child[here] + (rows[inner, feature[here]] > split[here])
            total += path[at]
        return np.exp2(-total / len(self.trees) / max(self.norm, 1e-9))


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def fit(stats: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """The forest and its threshold from ``stats(doc_id, ...)`` and ``labels(doc_id, quality)``.

    The driver gets at most FIT_ROWS rows and 2 * BINS counts. Null labels are ignored; of several labels of a document
    the worst counts. Without good rows there is no forest; without bad rows the threshold rejects MAX_GOOD_LOST.
    """
    worst = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    known = staged(stats.filter("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(worst, "doc_id"))
    sample = known.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id", *STATS).limit(FIT_ROWS).select(*STATS).collect()
    if not sample:
        return None, 1.0

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = features(np.stack([batch.column(c).to_numpy() for c in STATS], axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["f", "low", "high"])

    box = known.mapInArrow(spans, "f int, low double, high double").groupBy("f").agg(F.min("low"), F.max("high")).orderBy("f").collect()  # a row a feature
    forest = Forest(features(np.array(sample, np.int64)), np.array([r[1] for r in box]), np.array([r[2] for r in box]))
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2, BINS), np.int64)
        for batch in batches:
            score = shared.value.score(features(np.stack([batch.column(c).to_numpy() for c in STATS], axis=1)))
            good = (batch.column("quality").to_numpy() == 1).astype(np.int64)
            np.add.at(tally, (good, np.minimum((score * BINS).astype(np.int64), BINS - 1)), 1)
        good, at = np.nonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(good), pa.array(at), pa.array(tally[good, at])], names=["good", "bin", "n"])

    tally = np.zeros((2, BINS))
    for good, at, n in known.mapInArrow(bins, "good long, bin long, n long").groupBy("good", "bin").agg(F.sum("n")).collect():
        tally[good, at] = n
    lost = tally[:, ::-1].cumsum(axis=1)[:, ::-1] / np.maximum(tally.sum(axis=1, keepdims=True), 1)  # share at or over each bin
    gain = np.where(lost[1] <= MAX_GOOD_LOST, lost[0] - lost[1], -1.0)
    best = np.flatnonzero(gain == gain.max())
    return forest, float(best[-1] if gain.max() <= 0 else best[len(best) // 2]) / BINS


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, STATS..., base_failed, kept, score)``, one row for every row of ``docs``.

    Null and blank texts have no words and fail the base rules. ``labels(doc_id, quality)``. Repeated rows each give a
    row; an empty table gives none.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    stats = staged(slim.mapInArrow(_stats, "doc_id long, " + ", ".join(f"{c} long" for c in STATS)))
    forest, threshold = fit(stats, labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def verdict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in STATS], axis=1)
            failed = base_failed(rows)
            score = shared.value.score(features(rows)) if shared.value else np.zeros(len(rows))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed), pa.array(~failed & (score < threshold)), pa.array(score)], names=[*batch.schema.names, "base_failed", "kept", "score"]
            )

    return stats.mapInArrow(verdict, stats.withColumns({"base_failed": F.lit(True), "kept": F.lit(True), "score": F.lit(0.0)}).schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that fail the base rules or the forest; the verdict is computed beside the row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    stats = slim.mapInArrow(_stats, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))
    forest, threshold = fit(stats.join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    mark = private(docs, "good")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (str(x or "").encode("utf-8", "replace") for x in batch.column(text_col).to_pylist())
            rows = np.fromiter(chain.from_iterable(map(statistics, texts)), np.int64).reshape(-1, len(STATS))
            ok = ~base_failed(rows)
            if shared.value:
                ok &= shared.value.score(features(rows)) < threshold
            keep = pa.array(ok, pa.bool_())
            yield batch.append_column(mark, keep).filter(keep)

    return docs.mapInArrow(run, docs.withColumn(mark, F.lit(True)).schema).drop(mark)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept (and more) for every document."""
    return judged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
