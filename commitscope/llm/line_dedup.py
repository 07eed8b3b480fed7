"""Line de-duplication by suffix ranks over line-ID sequences.

Documents are sequences of line IDs (hashes of trimmed lines; blank lines are no part of the sequence). A run of
consecutive lines of at least ``min_words`` words that also occurs earlier (order: doc_id, row, line) is a later copy,
and its lines are deleted.

Distributed prefix doubling ranks suffixes by their first 1, 2, 4, ... lines: a rank at depth 2^(k+1) is the number of a
class of equal pairs (rank at depth 2^k here, rank at depth 2^k two to the k lines on), that is of the
longest-common-prefix interval of that depth. Numbers name the intervals and are not in the order of the lines, which
nothing here asks for; an interval also keeps its earliest suffix, and a suffix that is not the earliest of its interval
begins a later copy of 2^k lines. The doubling goes on until every suffix is alone in its interval or has been compared
to its document's end, so it takes log2 of the longest repeated run rounds.

Maximal repeated runs are unions of intervals: all sub-runs of a run that occurs earlier occur earlier, so a run of m
lines is the union of the later copies of 2^floor(log2 m) lines in it. Where such an interval has fewer than
``min_words`` words, its words do not decide: runs of up to ``min_words`` lines are also named exactly, by two overlapping
ranks, and every longer run has as many words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitscope.llm._common import load, private, staged

MIN_WORDS = 5
_SPACE = b" \t\n\x0b\x0c\r"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    names = ["doc_id", "row", "at", "line", "a", "b", "words"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
            parts = [(k, t) for k, x in enumerate(text.split(b"\n")) if (t := x.strip(_SPACE))]
            digests = b"".join(xxhash.xxh3_128_digest(t) for _, t in parts)
            halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
            n = len(parts)
            values = ([doc] * n, [row] * n, range(n), [k for k, _ in parts], halves[:, 0].tolist(), halves[:, 1].tolist(), [len(t.split()) for _, t in parts])
            for column, value in zip(out, values, strict=True):
                column.extend(value)
            if len(out[0]) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                out = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def lines(rows: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, row, at, line, a, b, words)``: non-blank lines, ``at`` counted over them, ``line`` over all lines.

    ``a, b`` are 128 bits of hash of the trimmed line; ``words`` is the number of its words. ``row_col`` names rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    slim = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(row_col).alias("row"), text)
    return slim.mapInArrow(_lines, "doc_id long, row long, at int, line int, a long, b long, words int")


def _classes(keyed: DataFrame, *keys: str) -> DataFrame:
    """``(*keys, rank, first, n)`` of the keys that stand on several rows: a number, the earliest place, the rows.

    Written out, so that rows join it by plain shuffles on both sides and a key with very many rows can be split by AQE.
    """
    found = keyed.groupBy(*keys).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return staged(found.withColumn("rank", F.monotonically_increasing_id()))


def intervals(found: DataFrame, deepest: int | None = None) -> list[DataFrame]:
    """Depth by depth (1, 2, 4, ... lines), the suffixes ``(row, at, words, pos, rank, first)`` that share an interval.

    ``first``: the earliest suffix of the interval ``rank``. ``found``: rows of ``lines()``, staged. Only lines that
    occur more than once take part, only suffixes of the last depth's intervals enter the next one, and the doubling
    ends when none is left (or at ``deepest``).
    """
    pos = F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.lit(0)).alias("d"), "row", "at")
    classes = _classes(found.select("a", "b", pos.alias("pos")), "a", "b")
    out = [staged(found.join(classes, ["a", "b"]).select("row", "at", "line", "words", pos.alias("pos"), "rank", "first"))]
    step = 1
    while (deepest is None or 2 * step <= deepest) and out[-1].take(1):
        on = Window.partitionBy("row").orderBy("at").rangeBetween(step, step)
        # a suffix whose fellow ``step`` lines on is alone in its interval, or beyond the end, is alone from here on
        pairs = staged(out[-1].withColumn("next", F.first("rank").over(on)).filter("next is not null").drop("first"))
        if not pairs.take(1):
            break
        classes = _classes(pairs.withColumnRenamed("rank", "one"), "one", "next")
        joined = pairs.withColumnRenamed("rank", "one").join(classes, ["one", "next"])
        out.append(staged(joined.select("row", "at", "line", "words", "pos", "rank", "first")))
        step *= 2
    return out if len(out) == 1 or out[-1].take(1) else out[:-1]


def _short(levels: list[DataFrame], min_words: int) -> DataFrame:
    """``(row, at, m)``: later copies of runs of m lines, the least m from or up to a line that has ``min_words`` words."""
    depth = len(levels) - 1
    keys = ["row", "at"]
    named = levels[0].select(*keys, "words", "pos", F.col("rank").alias("rank0"))
    for k, level in enumerate(levels[1:], 1):
        named = named.join(level.select(*keys, F.col("rank").alias(f"rank{k}")), keys, "left")

    def extents(sign: int) -> F.Column:
        over = [Window.partitionBy("row").orderBy("at").rangeBetween(*sorted((0, sign * (m - 1)))) for m in range(1, min_words + 1)]
        enough = ((F.sum("words").over(w) >= min_words) & (F.count(F.lit(1)).over(w) == m) for m, w in enumerate(over, 1))
        return F.coalesce(*(F.when(x, F.lit(m)) for m, x in enumerate(enough, 1)))

    sized = staged(named.withColumn("ahead", extents(1)).withColumn("behind", extents(-1)))
    forward = sized.filter("ahead is not null").select(*keys, F.col("ahead").alias("m"))
    backward = sized.filter("behind > 1").select("row", (F.col("at") - F.col("behind") + 1).alias("at"), F.col("behind").alias("m"))
    runs = forward.unionByName(backward).distinct()
    k = reduce(lambda out, k: F.when(F.col("m") >= 1 << k, F.lit(k)).otherwise(out), range(1, depth + 1), F.lit(0))
    runs = runs.withColumn("k", k).filter("m < shiftleft(2, k)").withColumn("tail", F.col("at") + F.col("m") - F.expr("shiftleft(1, k)"))

    def rank() -> F.Column:
        return reduce(lambda out, k: F.when(F.col("k") == k, F.col(f"rank{k}")).otherwise(out), range(1, depth + 1), F.col("rank0"))

    names = sized.select(*keys, "pos", *(f"rank{k}" for k in range(depth + 1)))
    head = runs.join(names, keys).select("row", "at", "m", "k", "tail", "pos", rank().alias("head"))
    tail = names.select("row", F.col("at").alias("tail"), *(f"rank{k}" for k in range(depth + 1)))
    both = head.join(tail, ["row", "tail"]).select("row", "at", "m", "pos", "head", rank().alias("end"))
    both = staged(both.filter("head is not null and end is not null"))
    return both.join(_classes(both, "m", "head", "end"), ["m", "head", "end"]).filter("first < pos").select("row", "at", "m")


def later_copies(found: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(row, at, m)``: intervals of m lines from the at-th non-blank line that repeat an earlier run of enough words.

    ``found``: rows of ``lines()``, staged (they are read several times). Their union is the union of all maximal
    repeated runs of at least ``min_words`` words.
    """
    levels = intervals(found)
    need = max(1, min_words)
    short = [x for k, x in enumerate(levels) if 1 << k <= need]
    out = _short(short, need)
    for k, level in enumerate(levels):
        if 1 << k >= need:
            out = out.unionByName(level.filter("first < pos").select("row", "at", F.lit(1 << k).alias("m")))
    return out


def _delete(text_col: str, starts: str, spans: str, names: list[str]):
    """Task over rows with their later copies: the text without them, how many lines went, whether all did."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone, empty = batch.column(text_col).to_pylist(), [], []
            for k, (at, m) in enumerate(zip(batch.column(starts).to_pylist(), batch.column(spans).to_pylist(), strict=True)):
                if at is None:
                    gone.append(0), empty.append(False)
                    continue
                parts = texts[k].split("\n")
                solid = [i for i, x in enumerate(parts) if x.strip(" \t\n\x0b\x0c\r")]
                edge = np.zeros(len(solid) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, np.add(at, m), -1)
                drop = {solid[i] for i in np.flatnonzero(edge.cumsum()[:-1])}
                gone.append(len(drop)), empty.append(len(drop) == len(solid))
                texts[k] = "" if empty[-1] else "\n".join(x for i, x in enumerate(parts) if i not in drop)
            kept = [batch.column(c) if c != text_col else pa.array(texts, batch.schema.field(c).type) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(gone, pa.int64()), pa.array(empty, pa.bool_())], names=[*names, starts, spans])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``, plus ``(lines_deleted, emptied)`` columns.

    Names of the two new columns get a trailing underscore where ``docs`` has them. Blank lines stay where they stand
    unless all other lines of the text went (then the text is empty and ``emptied`` is true). Null and blank texts are
    returned as they are. Of repeated rows the first in row order is the earlier. An empty table gives no rows. Rows are
    numbered once and written with their number, so it does not matter how the input is dealt when it is read again.
    """
    row, at, m = private(docs, "row_number"), private(docs, "copy_at"), private(docs, "copy_lines")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    found = staged(lines(rows, row, id_col, text_col))
    spans = later_copies(found, min_words).groupBy("row").agg(F.collect_list(F.struct("at", "m")).alias("s"))
    spans = staged(spans.select(F.col("row").alias(row), F.col("s.at").alias(at), F.col("s.m").alias(m)))
    # the side of the spans is hashed, so texts are not sorted
    out = rows.join(spans.hint("shuffle_hash"), row, "left").drop(row)
    count, empty = private(docs, "lines_deleted"), private(docs, "emptied")
    schema = docs.select("*", F.lit(0).cast("long").alias(at), F.lit(True).alias(m)).schema
    return out.mapInArrow(_delete(text_col, at, m, docs.columns), schema).withColumnsRenamed({at: count, m: empty})


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_deleted, emptied, text for every document: later copies of repeated line runs deleted."""
    return line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "lines_deleted", "emptied", "text")


def _sql() -> str:
    """Every line has a word, so each long run is the union of its sub-runs of at most five lines that have five words."""
    runs = " UNION ALL ".join(f"SELECT doc_id, place, {m} AS m, list(t) OVER w AS run, sum(n) OVER w AS n FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)" for m in range(1, MIN_WORDS + 1))
    return f"""
WITH raw AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
trimmed AS (SELECT doc_id, line, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM raw),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS place, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n FROM trimmed WHERE t <> ''),
runs AS (SELECT doc_id, place, m, run FROM ({runs}) WHERE len(run) = m AND n >= {MIN_WORDS}),
sources AS (SELECT m, run, min({{'d': doc_id, 'place': place}}) AS first FROM runs GROUP BY m, run HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(place, place + m)) AS place FROM runs JOIN sources USING (m, run) WHERE {{'d': doc_id, 'place': place}} > first),
texts AS (SELECT raw.doc_id, count(gone.place) AS gone, count(solid.place) AS solid, string_agg(x, chr(10) ORDER BY raw.line) FILTER (gone.place IS NULL) AS rest
    FROM raw LEFT JOIN solid USING (doc_id, line) LEFT JOIN gone ON gone.doc_id = solid.doc_id AND gone.place = solid.place GROUP BY raw.doc_id)
SELECT doc_id, coalesce(gone, 0) AS lines_deleted, coalesce(gone > 0 AND gone = solid, false) AS emptied,
    CASE WHEN gone > 0 AND gone = solid THEN '' WHEN gone > 0 THEN rest ELSE text END AS text FROM documents LEFT JOIN texts USING (doc_id)
"""


SQL = _sql()
