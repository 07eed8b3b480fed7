"""SimHash groups against fingerprints computed bit by bit and links found by comparing all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from commitscope.llm import simhash


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, bits):
    up = list(range(len(items)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(items):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return {doc: least[root(i)] for i, (doc, _) in enumerate(items)}


def test_query_is_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.doc_id, brute_fingerprint(r.text, 4)) for r in docs]
    comp = brute_components(items, 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash(spark, data).collect()}
    assert got == {doc: (f"{fp:016x}", comp[doc]) for doc, fp in items}
    assert len(set(comp.values())) < len(comp)


@pytest.mark.parametrize("hot", [3, 50_000])
def test_clusters_chains_and_hot_lists(spark, hot):
    rng = random.Random(3)
    fps = []
    for _ in range(40):  # chains: each step flips up to five bits, so that some steps link and some do not
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                at ^= 1 << b
            fps.append(at)
    centre = rng.getrandbits(64)  # one large group of near copies
    fps += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)]
    fps += [0, 0, 1 << 63, 2**64 - 1]
    items = [(k * 3 % 1009, fp) for k, fp in enumerate(fps)]
    rows = [(d, int(np.array([fp], np.uint64).view(np.int64)[0])) for d, fp in items]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, fp long"), hot).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(items, 4)


def test_covering_design_keeps_every_pair():
    from itertools import combinations

    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_odd_rows(spark, documents):
    docs = documents([(5, None), (4, ""), (3, " \t\n"), (7, "one"), (7, "one"), (None, "one"), (9, "A b C d e"), (8, "a B c D E")], fp="x", component_id="y")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_groups(simhash.fingerprints(docs)).collect()), key=str)
    comp = {d: c for d, _, c in got}
    assert len(got) == 8
    assert comp[5] == comp[4] == comp[3] == 3 and comp[7] == comp[None] == 7 and comp[9] == comp[8] == 8
    assert all(fp == 0 for d, fp, _ in got if d in (3, 4, 5))
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert simhash.near_dedup(documents([(None, "x y"), (None, "x y")])).count() == 1
    assert simhash.near_dedup(documents([])).count() == 0
    assert simhash.near_groups(simhash.fingerprints(documents([]))).count() == 0


def test_long_text(spark, documents):
    words = [f"w{k % 7919}" for k in range(120_000)]
    text = " ".join(words)
    near = " ".join(["changed", *words[1:]])
    got = {r.doc_id: r.component_id for r in simhash.near_groups(simhash.fingerprints(documents([(2, text), (1, near), (3, "other words here now")]))).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def edited(rng, base, edits):
    out = list(base)
    for k in rng.sample(range(0, len(out), 6), edits):
        out[k] = f"x{rng.randrange(10**6)}"
    return out


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_near_copies_by_similarity(spark, documents):
    rng = random.Random(5)
    rows, bands = [], {}
    for k in range(400):
        base = [f"t{rng.randrange(50_000)}" for _ in range(300)]
        copy = edited(rng, base, 1 + k % 6)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        bands.setdefault(int(jaccard(base, copy) * 20) / 20, []).append(2 * k + 1)
    kept = {r.doc_id for r in simhash.near_dedup(documents(rows)).collect()}
    assert all(2 * k in kept for k in range(400))
    recall = {b: sum(d not in kept for d in ids) / len(ids) for b, ids in bands.items()}
    assert min(bands) >= 0.8 and all(r >= 0.99 for r in recall.values())


def test_common_shingles_do_not_change_a_result(spark, documents):
    """Near copies that share a passage with very many others; counted in small blocks, so that blocks are several."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(80)]
    rows = []
    for k in range(150):
        base = [f"t{rng.randrange(50_000)}" for _ in range(60)]
        rows += [(2 * k, " ".join([*passage, *base])), (2 * k + 1, " ".join([*passage, *edited(rng, base, k % 5)]))]
    docs = documents(rows)
    common = simhash.common_shingles(docs)
    assert len(common) >= 76
    plain = simhash.components(simhash.near_links(docs, simhash.staged(simhash.shingle_sets(docs))))
    slow = simhash.components(simhash.near_links(docs, simhash.staged(simhash.shingle_sets(docs, common=common))))
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in slow.collect()} and plain.count() >= 80
    heads = simhash.shingle_sets(docs, common=common).select("prefix").collect()
    often = set(common.view(np.int64).tolist())
    assert sum(len(often & set(r.prefix)) for r in heads) < 0.1 * sum(len(r.prefix) for r in heads)


def test_rows_of_one_id_with_unlike_texts_are_judged_apart(spark, documents):
    texts = [" ".join(f"{x}{k}" for k in range(40)) for x in "abc"]
    docs = documents([(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1]), (0, texts[0]), (None, texts[2]), (None, texts[2])])
    got = sorted(((r.doc_id, texts.index(r.text)) for r in simhash.near_dedup(docs).collect()), key=str)
    assert got == sorted([(0, 0), (1, 1), (None, 2)], key=str)


def test_unlike_texts_are_not_near(spark, documents):
    rng = random.Random(6)
    shared = [f"s{k}" for k in range(60)]
    rows = [(k, " ".join([*(f"t{rng.randrange(50_000)}" for _ in range(120)), *shared, *(f"t{rng.randrange(50_000)}" for _ in range(120))])) for k in range(300)]
    assert simhash.near_dedup(documents(rows)).count() == 300


@pytest.mark.parametrize("fields", [1, 4])
def test_long_lists_are_searched_to_the_last_member(fields):
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(17, 40))
        fp = rng.integers(0, 2**63, (n, fields), dtype=np.uint64)
        for k in range(n // 2):  # pairs of near copies among strangers
            fp[n - 1 - k] = fp[k]
            fp[n - 1 - k, 0] ^= np.uint64(5)
        node = np.arange(n)
        links = set(map(frozenset, simhash.links_in_lists(np.zeros(n, np.int64), node, fp, 4, 4)))
        assert links == {frozenset((k, n - 1 - k)) for k in range(n // 2)}


def test_near_stage_is_brute_force_at_the_asked_similarity(spark, documents):
    rng = random.Random(8)
    texts = []
    for k in range(150):  # copies on both sides of 0.8, some short, some with a repeated passage
        base = [f"t{rng.randrange(50_000)}" for _ in range(rng.choice((9, 40, 300)))]
        copy = edited(rng, base, 1 + k % max(1, len(base) // 50))
        if k % 3 == 0:
            copy = [*base, *base[:10] * 20, f"y{k}"]
        texts += [base, copy, copy[: len(copy) * 9 // 10]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    up = list(range(len(texts)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert 150 < len({root(i) for i in up}) < 400
    kept = {r.doc_id for r in simhash.near_dedup(documents([(k, " ".join(w)) for k, w in enumerate(texts)])).collect()}
    assert kept == {i for i in range(len(texts)) if root(i) == i}


@pytest.mark.parametrize("most", [200, 1 << 20])
def test_large_groups_are_compared_in_blocks(spark, documents, most):
    base = [f"w{k}" for k in range(60)]
    docs = documents([(k, " ".join([*base, f"x{k}"])) for k in range(40)] + [(99, "none of the others at all")])
    links = simhash.near_links(docs, simhash.staged(simhash.shingle_sets(docs)), hot=3, most=most)
    assert {x for r in links.collect() for x in r} == {r.node for r in simhash.shingle_sets(docs).filter("doc_id < 99").collect()}
