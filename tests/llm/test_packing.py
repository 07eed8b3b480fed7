"""Packing: pieces, gapless places, bounds, and how near the number of sequences is to the least possible."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from commitscope.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_places(rows, size=packing.SIZE):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_query(spark, data):
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = packing.op6_packing(spark, data).collect()
    per = defaultdict(list)
    for r in rows:
        per[r.doc_id].append(r)
    assert per.keys() == texts.keys()
    total = 0
    for doc, held in per.items():
        ids = np.array([*library.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        held.sort(key=lambda r: r.piece)
        assert [r.piece for r in held] == list(range(len(held)))
        assert sum(r.length for r in held) == len(ids) and (len(held) == 1) == (len(ids) <= 2048)
        assert all(r.length == 2048 for r in held[1:]) if len(ids) > 2048 else True
        at = 0
        for r in held:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        total += len(ids)
    used = check_places(rows)
    assert used <= math.ceil(total / 2048) + 1


def brute_fullest(counts, room):
    items = list(counts.items())
    return max(s for n in product(*(range(c + 1) for _, c in items)) if (s := sum(k * length for k, (length, _) in zip(n, items, strict=True))) <= room)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 60))
def test_fullest_is_optimal(counts, room):
    chosen = dict(packing.fullest(counts, room))
    assert all(n <= counts[k] for k, n in chosen.items())
    assert sum(k * n for k, n in chosen.items()) == brute_fullest(counts, room)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_piece_once(counts):
    used = defaultdict(int)
    for bins, filling in packing.plan(counts, 64):
        assert sum(k * n for k, n in filling) <= 64
        for k, n in filling:
            used[k] += bins * n
    assert used == counts


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 4096, 4097, 10_000])
def test_piece_lengths(n):
    found = packing.piece_lengths(n)
    assert sum(found) == n and max(found) <= 2048 and all(x == 2048 for x in found[1:]) and len(found) == math.ceil(n / 2048)


def test_plan_is_near_the_bound():
    rng = random.Random(2)
    counts = defaultdict(int)
    for _ in range(50_000):
        counts[min(2048, int(rng.lognormvariate(5.5, 1)) + 1)] += 1
    bins = sum(b for b, _ in packing.plan(counts))
    assert bins <= math.ceil(sum(k * n for k, n in counts.items()) / 2048) * 1.001 + 1


def test_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (3, "same text"), (3, "same text"), (None, "null"), (4, "word " * 30_000)], row="r", length="l", task="t")
    rows = packing.pack(docs, PATH).collect()
    check_places(rows)
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert len({r.row for r in rows}) == 6
    assert len([r for r in rows if r.doc_id == 4]) == math.ceil(30_002 / 2048)
    assert packing.pack(documents([]), PATH).count() == 0
