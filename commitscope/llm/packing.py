"""Sequence packing by minimum bin slack over token-length classes.

Documents become token pieces of at most ``SIZE`` tokens. Packing depends only on how many pieces each length has, a
histogram of at most ``SIZE`` numbers, which is all the driver receives. For each bin the longest remaining length is
placed and a bitset subset-sum dynamic program over the available lengths finds the fullest feasible filling; the same
combination is removed as often as the counts allow, so the plan has a number of rows bounded by the lengths and not by
the pieces. Pieces then find their place by their rank within their length: ranks come from per-task counts, so no
length class is ever gathered.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commitscope.llm._common import load, private, staged

SIZE = 2048
PLACED = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
#: The pre-tokens of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Byte-level BPE ids of whole texts, little-endian 32-bit, as the tokenizers library gives them.

    The vocabulary's merge ranks are run by the faster library; texts with a special token's string go through the
    tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        from commitscope.llm.bpe import byte_letters

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        value = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(value.__getitem__, t)): k for t, k in self.whole.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.ranked(text)).tobytes()


@cache
def encoder(path: str) -> Encoder:
    """This process's encoder: a worker keeps it from task to task."""
    return Encoder(path)


def piece_lengths(n: int, size: int = SIZE) -> list[int]:
    """Only documents over ``size`` are cut; then all pieces but the first are full."""
    if n <= size:
        return [n]
    return [n % size or size] + [size] * ((n - 1) // size)


def _pieces(path: str, end: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = ids_of(text) + tail
                at = 0
                for k, n in enumerate(piece_lengths(len(data) // 4, size)):
                    values = (row, doc, k, at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), int(seen[n]))
                    seen[n] += 1
                    at += n
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            arrays.append(pa.array([task] * len(out[0]), pa.int32()))
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return run


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and multiplicities with the greatest sum of at most ``room``; ``counts`` by length.

    Bitset subset-sum dynamic programming: bit s of a set says that sum s can be reached. Longer lengths come first,
    and the search ends as soon as the room can be filled exactly.
    """
    mask, reach = (1 << room + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = counts[length], 1
        while left > 0 and length * many <= room:  # multiplicities in binary parts
            take = min(many, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left -= take
            many *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return sorted(chosen.items(), reverse=True)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum-bin-slack plan: (bins, [(length, pieces a bin), ...]) until no piece is left."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        filling = dict(fullest({k: v for k, v in left.items() if v}, size - top))
        left[top] += 1
        filling[top] = filling.get(top, 0) + 1
        bins = min(left[k] // n for k, n in filling.items())
        out.append((bins, sorted(filling.items(), reverse=True)))
        for k, n in filling.items():
            left[k] -= bins * n
            if not left[k]:
                del left[k]
    return out


def pack(docs: DataFrame, tokenizer: str, end: int = 0, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row a piece of every row of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE file, the same on every machine. Null text counts as empty (a piece
    of the end id alone). ``row`` numbers the rows, so repeated or null ids stay apart. An empty table gives no rows.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, nth long, task int"
    pieces = staged(slim.mapInArrow(_pieces(tokenizer, end, size), kinds))
    tally = staged(pieces.groupBy("length", "task").count())
    earlier = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = tally.select("length", "task", F.coalesce(earlier, F.lit(0)).alias("before"))
    counts = {r[0]: r[1] for r in tally.groupBy("length").agg(F.sum("count")).collect()}  # at most ``size`` rows
    spans, used, first = [], dict.fromkeys(counts, 0), 0
    for bins, filling in plan(counts, size):
        offset = 0
        for length, n in filling:
            spans.append((length, used[length], used[length] + bins * n, n, first, offset))
            used[length] += bins * n
            offset += length * n
        first += bins
    # A plan row leaves one of its lengths with fewer pieces than a bin takes, at most size / length; so a length ends at
    # most as many rows, there are at most size * (ln size + 2) rows of a few lengths each, and the spans are under 20 MB.
    table = np.array(sorted(spans), np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, low, high, n, first, base = shared.value.T
        ends = (length << 48) + high
        for batch in batches:
            mine, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(ends, (mine << 48) + rank, side="right")
            nth = rank - low[k]
            kept = [batch.column(c) for c in ("row", "doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[k] + nth // n[k]), pa.array(base[k] + nth % n[k] * mine)], names=PLACED)

    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("nth") + F.col("before"))
    return ranked.mapInArrow(place, "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    import public_tokenizers

    return pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("row")
