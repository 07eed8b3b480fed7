"""SimHash near-duplicate grouping with a byte-position inverted index and count filtering.

A 64-bit fingerprint has eight positional bytes. Two fingerprints that differ in at most four bits agree in at least
four positional bytes (the guaranteed minimum). The index posts each distinct fingerprint under three-byte keys chosen
as a covering design: every four of the eight positions contain one of the twenty triples, so each qualifying pair
meets in some posting list, and lists stay short (2^24 values a triple) where single-byte lists would hold n/256
entries each. Inside a list the shared positional bytes of a pair are tallied; pairs under the minimum are discarded,
the others are verified by their Hamming distance.

Pairs are never emitted for a list: up to ``SMALL`` members are compared by shifted arrays, longer lists are searched
breadth-first with vectorised distances, and either way only a spanning forest of links leaves the task. Lists longer
than ``HOT`` are cut into blocks and every two blocks meet in one task, so that one hot list is shared by many tasks.
Equal fingerprints are folded before the index, hence a group of exact copies costs one posting per triple.

Four bits of 64 are a similarity of about 0.95. ``near_dedup`` is asked for a Jaccard similarity of 0.8 of five-word
shingle sets, at which no number of equal bytes is certain. Its lists are therefore posted under shingle hashes: of a
set of n hashes in ascending order the first n - ceil(0.8 n) + 1, one of which any two sets of that similarity share.
A 256-bit SimHash of the set bounds the chains inside lists (80 bits, over five standard deviations above the mean
distance at 0.8), and the members of each group so proposed are compared by the exact Jaccard similarity of their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitscope.llm._common import load, private, staged, utf8
from commitscope.llm._graph import components

BITS, MIN_SHARED, SMALL, HOT = 4, 4, 16, 50_000
#: Shingles that are hashed at a time: bounded scratch memory for very long texts.
BLOCK = 65_536
WIDE, PROPOSE_BITS = ("f0", "f1", "f2", "f3"), 80
#: Least similarity of near copies as a fraction, and the bytes of one group's texts that a task compares at a time.
NEAR, GROUP_BYTES = (4, 5), 32 << 20
#: Common shingles that are posted last, and hashes that are counted at a time to find them.
COMMON, COUNTED = 1 << 16, 1 << 21
_MIX = np.array([0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F, 0x78DDE6E5FD29F054], np.uint64)
_LANES = np.uint64(0x0101010101010101)

_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))
#: Twenty triples of byte positions such that any four positions contain one of them.
TRIPLES = tuple(
    t
    for t in combinations(range(8), 3)
    if (n := tuple(sum(p in g for p in t) for g in _GROUPS)) in {(3, 0, 0), (0, 3, 0), (2, 1, 0), (0, 2, 1), (1, 0, 2)}
)
#: For each mask of equal positions, the first triple inside it: a pair counts in that list alone.
_FIRST = np.array([next((k for k, t in enumerate(TRIPLES) if all(m >> p & 1 for p in t)), -1) for m in range(256)], np.int64)


def _shingles(text: bytes, words: int) -> tuple[Iterator[bytes], int]:
    """The lower-cased (A-Z) word shingles, repeats included, and their number; fewer words make one shingle."""
    parts = text.lower().split()
    if not parts:
        return iter(()), 0
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1)
    k = min(words, len(parts))
    n = len(parts) - k + 1
    return map(joined.__getitem__, map(slice, (ends - sizes - 1)[:n].tolist(), (ends[k - 1 :] - 1).tolist())), n


def _majority(blocks: Iterator[np.ndarray], n: int) -> np.ndarray:
    """Words whose bits are set in over half of ``n`` rows; ``blocks``: rows x words of 64 bits, a block at a time.

    Eight bits of a word are counted at once, one a byte lane, over at most 255 rows.
    """
    total: np.ndarray | int = 0
    for h in blocks:
        at = np.arange(0, len(h), 255)
        lanes = [np.add.reduceat((h >> np.uint64(b)) & _LANES, at, axis=0).view(np.uint8) for b in range(8)]
        total = total + np.stack([x.reshape(len(at), -1, 8).sum(axis=0, dtype=np.int64) for x in lanes], axis=-1)
    return np.packbits(2 * total > n, axis=-1, bitorder="little")[..., 0].copy().view("<u8")[:, 0]


def fingerprint(text: bytes, words: int) -> int:
    """Unsigned 64-bit SimHash over XXH64 (seed 42) of the shingles; 0 without words."""
    shingles, n = _shingles(text, words)
    if not n:
        return 0
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    return int(_majority((np.fromiter(islice(hashes, BLOCK), np.uint64)[:, None] for _ in range(0, n, BLOCK)), n)[0])


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending: XXH3 of the words, mixed in their order; without words, one of its own."""
    parts = text.lower().split()
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ word[i : i + n]) * _MIX[0]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Four words of a 256-bit SimHash of a shingle set: each hash is mixed with four seeds."""

    def mixed(x: np.ndarray) -> np.ndarray:
        x = x[:, None] + _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    return _majority((mixed(hashes[i : i + BLOCK]) for i in range(0, len(hashes), BLOCK)), len(hashes))


def _fingerprints(words: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x, words) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(got.view(np.int64))], names=[*carry, "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row, ``fp`` a signed 64-bit long. Null text counts as empty (fingerprint zero)."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return slim.mapInArrow(_fingerprints(words, ["doc_id"]), "doc_id long, fp long")


def common_shingles(docs: DataFrame, text_col: str = "text", words: int = 5, most: int = COMMON) -> np.ndarray:
    """Hashes of at most ``most`` very common shingles, the most common last; what is in it never changes a result.

    Every shingle of every row is counted in blocks of about ``COUNTED`` hashes; a block reports those that stand in
    three of its rows and in one of 500, so what is reported is small, whatever the size of the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = n = 0

        def flush() -> pa.RecordBatch:
            key, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= max(3, -(-rows // 500))
            return pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(count[often])], names=["key", "n"])

        for batch in batches:
            for x in batch.column("text").to_pylist():
                held.append(shingle_set(x, words))
                rows, n = rows + 1, n + len(held[-1])
                if n > COUNTED:
                    yield flush()
                    held, rows, n = [], 0, 0
        if held:
            yield flush()

    tally = docs.select(utf8(text_col).alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = tally.orderBy(F.desc("n"), "key").limit(most).collect()
    return np.array([r[0] for r in reversed(found)], np.int64).view(np.uint64)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, common: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, t, node, f0, f1, f2, f3, prefix)`` for every row.

    ``t``: MD5 of the text; ``node``: hash of its shingle set; then the set's 256-bit fingerprint and the hashes it is
    posted under: the first of the set in one order of all hashes, in which ``common`` ones come last.
    """
    common = np.zeros(0, np.uint64) if common is None else common
    shared = docs.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common)))  # at most COMMON longs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, place = shared.value

        def ordered(hashes: np.ndarray) -> np.ndarray:
            if not len(often):
                return hashes
            at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
            hit = often[at] == hashes
            return np.concatenate([hashes[~hit], hashes[hit][np.argsort(place[at[hit]])]]) if hit.any() else hashes

        for batch in batches:
            nodes, prints, heads = [], [], []
            for x in batch.column("text").to_pylist():
                hashes = shingle_set(x, words)
                n = len(hashes)
                nodes.append(xxhash.xxh3_64_intdigest(hashes.tobytes()))
                prints.append(wide_fingerprint(hashes))
                heads.append(ordered(hashes)[: n + 1 - -(-n * NEAR[0] // NEAR[1])].view(np.int64))
            f = np.array(prints, np.uint64).reshape(-1, 4).view(np.int64)
            node = pa.array(np.array(nodes, np.uint64).view(np.int64))
            prefix = pa.array(heads, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), node, *(pa.array(f[:, k].copy()) for k in range(4)), prefix], names=["doc_id", "t", "node", *WIDE, "prefix"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(utf8(text_col)).alias("t"), utf8(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, t string, node long, " + ", ".join(f"{f} long" for f in WIDE) + ", prefix array<long>")


class _Forest:
    """Union-find over fingerprints of one task; keeps only links that join two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def add(self, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
        kept = []
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append((a, b))
        return kept


def _close(x: np.ndarray, bits: int, shared: int) -> np.ndarray:
    """Count filter (equal positional bytes), then the Hamming distance, over XORed fingerprints (rows x quarters)."""
    ok = (x.view(np.uint8).reshape(len(x), 8 * x.shape[1]) == 0).sum(axis=1) >= shared
    ok[ok] = np.bitwise_count(x[ok]).sum(axis=1, dtype=np.int64) <= bits
    return ok


def _long_list(node: np.ndarray, fp: np.ndarray, bits: int, shared: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of one long list: breadth-first search against the members not reached yet."""
    queue: list[tuple[int, np.ndarray]] = []
    while len(fp):
        if not queue:
            queue, node, fp = [(int(node[0]), fp[0])], node[1:], fp[1:]
        at, mine = queue.pop()
        near = _close(fp ^ mine, bits, shared)
        if near.any():
            found = node[near].tolist()
            yield from zip(repeat(at), found)
            queue.extend(zip(found, fp[near], strict=True))
            node, fp = node[~near], fp[~near]


def links_in_lists(key: np.ndarray, node: np.ndarray, fp: np.ndarray, bits: int = BITS, shared: int = MIN_SHARED, triples: bool = True) -> Iterator[tuple[int, int]]:
    """Links inside complete posting lists; rows are sorted by key. ``fp``: rows x quarters; ``triples``: keys are of byte triples."""
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, len(key)])
    few = np.repeat(size <= SMALL, size)
    triple = (key >> 24) & 127
    for s in range(1, min(SMALL, len(key))):
        i = np.flatnonzero(few[:-s] & (key[s:] == key[:-s]))
        if not len(i):
            break
        x = fp[i] ^ fp[i + s]
        ok = _close(x, bits, shared)
        if triples:
            i, x = i[ok], x[ok]
            # of the lists that a pair meets in within a quarter, the first alone gives the link
            quarter = triple[i] // len(TRIPLES)
            mask = np.packbits(x[np.arange(len(i)), quarter][:, None].view(np.uint8) == 0, axis=1, bitorder="little")[:, 0]
            i = i[_FIRST[mask] == triple[i] % len(TRIPLES)]
        else:
            i = i[ok]
        yield from zip(node[i].tolist(), node[i + s].tolist(), strict=True)
    for k in np.flatnonzero(size > SMALL):
        span = slice(cut[k], cut[k] + size[k])
        yield from _long_list(node[span], fp[span], bits, shared)


def _link(fields: tuple[str, ...], bits: int, shared: int, triples: bool = True):
    """Task over postings sorted by unit; the first field names a fingerprint of one field, ``node`` one of more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            got = np.array(forest.add(links_in_lists(key, node, fp, bits, shared, triples)), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            k = batch.column("unit").to_numpy()
            if not len(k):
                continue
            f = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in fields], axis=1)
            n = batch.column("node").to_numpy() if "node" in batch.schema.names else batch.column(fields[0]).to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last or (held and held[-1][0][-1] != k[0]):
                held.append((k[:last], n[:last], f[:last]))
                yield flush(*map(np.concatenate, zip(*held, strict=True)))
                held = []
            held.append((k[last:], n[last:], f[last:]))
        if held:
            yield flush(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _postings(fps: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each row under one key for every quarter and triple of byte positions."""
    keys = []
    for q, field in enumerate(fields):
        byte = [F.shiftrightunsigned(field, 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
        keys += [F.lit((q * len(TRIPLES) + k) << 24) + byte[a] * 65_536 + byte[b] * 256 + byte[c] for k, (a, b, c) in enumerate(TRIPLES)]
    return fps.select("*", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))


def link_units(fps: DataFrame, hot: int = HOT, fields: tuple[str, ...] = ("fp",)) -> DataFrame:
    """Postings dealt to work units: a list is one unit; a list over ``hot`` is one unit for every two of its blocks."""
    # bits 0-30: quarter, triple and bytes; above: the two blocks plus one, up to 2^16 blocks each
    return _dealt(_postings(fps, fields), hot, fields, lambda low, high: F.col("key") + F.shiftleft(low + 1, 31) + F.shiftleft(high + 1, 47))


def _dealt(posted: DataFrame, hot: int, fields: tuple[str, ...], unit: Callable[[F.Column, F.Column], F.Column]) -> DataFrame:
    """Work units of ``posted(key, ...)``; ``unit`` names the one of two blocks of a list.

    List lengths are bounded above by counts over hash slots, of which there are so many that a slot's share of all
    postings is a sixteenth of ``hot``: only lists that are long make a slot long, at any size. The table of hot slots
    has at most one row for ``hot`` postings and is joined without a hint, so its size decides how. A slot that only
    looks hot is cut too, which costs copies but no link.
    """
    slots = 1 << max(10, (16 * posted.count() // hot).bit_length())
    slot = F.pmod(F.xxhash64("key"), F.lit(slots))
    carry = [c for c in posted.columns if c != "key"]
    hot_slots = posted.groupBy(slot.alias("slot")).count().filter(F.col("count") > hot)
    hot_slots = staged(hot_slots.select("slot", F.ceil(F.col("count") / hot).cast("int").alias("blocks")))
    if not hot_slots.take(1):
        return posted.select(F.col("key").alias("unit"), *carry)
    dealt = posted.withColumn("slot", slot).join(hot_slots, "slot", "left")
    mine = F.pmod(F.xxhash64(F.lit(5), *fields), F.col("blocks"))
    dealt = dealt.select("key", *carry, "blocks", mine.alias("mine"))
    cold = dealt.filter("blocks is null").select(F.col("key").alias("unit"), *carry)
    split = dealt.filter("blocks is not null").select("key", *carry, "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("mine", "other").cast("long"), F.greatest("mine", "other").cast("long")
    return cold.unionByName(split.select(unit(low, high).alias("unit"), *carry))


def near_groups(fp: DataFrame, hot: int = HOT, fields: tuple[str, ...] = ("fp",), bits: int = BITS, shared: int = MIN_SHARED) -> DataFrame:
    """``(doc_id, fields...)`` -> those and ``component_id``: the least doc_id reachable over links of at most ``bits`` bits.

    Null ids take part but never name a group unless all its ids are null (then component_id is null). Rows that
    repeat an id each keep their row. An empty table gives no rows.
    """
    fp = staged(fp)
    each = fp.groupBy(*fields).agg(F.min("doc_id").alias("least"))
    each = staged(each.withColumn("node", F.col(fields[0]) if len(fields) == 1 else F.monotonically_increasing_id()))
    units = link_units(each.select(*fields, *["node"] * (len(fields) > 1)), hot, fields)
    edges = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_link(fields, bits, shared), "a long, b long")
    named = each.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = staged(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # staged: the last join then has plain shuffles on both sides, and rows of one fingerprint can be split by AQE
    label = staged(named.select("root", *fields).join(least, "root").select(*fields, "component_id"))
    return fp.join(label, list(fields), "left")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings sorted by key, without those that are alone under their key."""
    held: pa.RecordBatch | None = None  # the last row so far, and whether it has a fellow
    paired = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        if held is not None:
            meets = held.column("key")[0].as_py() == key[0]
            if meets or paired:
                yield held
            keep[0] |= meets
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        held, paired = batch.slice(batch.num_rows - 1), bool(keep[-1])
    if paired:
        yield held


def links_of_sets(node: list[int], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is at least ``NEAR``: breadth-first search."""
    size = np.array(list(map(len, sets)), np.int64)
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mine = np.zeros(int(size.sum()), bool)
    left, queue = np.arange(len(sets)), []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        mine[ids[at]] = True
        near = NEAR[1] * np.minimum(size[left], size[at]) >= NEAR[0] * np.maximum(size[left], size[at])
        can = left[near]
        common = np.fromiter((np.count_nonzero(mine[ids[k]]) for k in can), np.int64, len(can))
        mine[ids[at]] = False
        near[near] = NEAR[1] * common >= NEAR[0] * (size[can] + size[at] - common)
        for k in left[near].tolist():
            yield node[at], node[k]
            queue.append(k)
        left = left[~near]


def _verify(words: int):
    """Task over the texts of proposed groups, sorted by unit: links of exact similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, node, sets = None, [], []

        def flush() -> pa.RecordBatch:
            got = np.array(list(links_of_sets(node, sets)) if len(sets) > 1 else [], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            for u, k, text in zip(*(batch.column(c).to_pylist() for c in ("unit", "node", "text")), strict=True):
                if u != unit:
                    yield flush()
                    unit, node, sets = u, [], []
                node.append(k)
                sets.append(shingle_set(text, words))
        yield flush()

    return run


def near_links(docs: DataFrame, sets: DataFrame, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", words: int = 5, most: int = GROUP_BYTES) -> DataFrame:
    """``(a, b)``: links between nodes of ``sets = shingle_sets(docs)`` that join every two of similarity ``NEAR`` or more."""
    nodes = staged(sets.select("node", *WIDE, "prefix").dropDuplicates(["node"]))
    posted = nodes.select(F.explode("prefix").alias("key"), "node").repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long")
    posted = staged(posted.join(nodes.select("node", *WIDE), "node").select("key", *WIDE, "node"))
    units = _dealt(posted, hot, WIDE, lambda low, high: F.xxhash64("key", low, high))
    edges = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_link(WIDE, PROPOSE_BITS, 0, False), "a long, b long")
    found = staged(components(edges))
    member = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    # one row stands for all of equal sets
    one = sets.select("node", "t", "doc_id").join(member, "node").groupBy("node", "root").agg(F.min(F.struct("t", "doc_id")).alias("r"))
    one = one.select("node", "root", F.col("r.t").alias("t"), F.col("r.doc_id").alias("doc_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.md5(utf8(text_col)).alias("t"), utf8(text_col).alias("text"))
    texts = rows.join(one, (rows["t"] == one["t"]) & rows["id"].eqNullSafe(one["doc_id"])).select("node", "root", "text")
    texts = staged(texts.dropDuplicates(["node"]))
    # a group over ``most`` bytes is cut into blocks, and every two blocks meet in one task
    # (staged: the join has plain shuffles on both sides, and the texts of one group can be split by AQE)
    large = staged(texts.groupBy("root").agg(F.ceil(F.sum(F.octet_length("text")) / most).cast("int").alias("blocks")).filter("blocks > 1"))
    cut = texts.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.when(F.col("blocks") == 1, F.col("root")).otherwise(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")))
    cut = cut.select(unit.alias("unit"), "node", "text").repartition("unit").sortWithinPartitions("unit")
    return cut.mapInArrow(_verify(words), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """``docs`` with one document of each near-duplicate group (similarity of 0.8 or more): the one with the least id.

    All columns pass unchanged. Null ids come last; of rows that repeat the least id, the one with the least MD5 of its
    text stays, and of rows that repeat both, one. Empty texts form one group. An empty table gives no rows.
    """
    sets = staged(shingle_sets(docs, id_col, text_col, words, common_shingles(docs, text_col, words)))
    root = components(near_links(docs, sets, HOT, id_col, text_col, words))
    groups = sets.select("doc_id", "t", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    n, key, text = private(docs, "copies"), private(docs, "kept_id"), private(docs, "kept_text")
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t")).alias("k")).select(F.col("k.doc_id").alias("least_id"), F.col("k.t").alias("least_t"))
    rows = sets.groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias(n))
    kept = staged(rows.join(least, F.col("doc_id").eqNullSafe(F.col("least_id")) & (F.col("t") == F.col("least_t")), "left_semi"))
    kept = kept.select(F.col("doc_id").alias(key), F.col("t").alias(text), n)
    on = docs[id_col].cast("long").eqNullSafe(F.col(key)) & (F.md5(utf8(text_col)) == F.col(text))
    once = docs.join(kept.filter(F.col(n) == 1).drop(n).hint("shuffle_hash"), on, "left_semi")
    if not kept.filter(F.col(n) > 1).take(1):
        return once
    again = docs.join(kept.filter(F.col(n) > 1).drop(n), on, "left_semi").withColumn(text, F.md5(utf8(text_col)))
    return once.unionByName(again.dropDuplicates([id_col, text]).drop(text))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over all documents: 4-word shingles, at most 4 bits."""
    got = near_groups(fingerprints(load(spark, sf_dir, "documents"), words=4))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
