"""Extendible hashing against SQL, and shards under the limit on odd rows."""

from __future__ import annotations

from collections import defaultdict

from commitscope.llm import sharding


def test_query_is_sql(spark, data, duck, rows):
    assert rows(sharding.op4_sharding(spark, data)) == duck(sharding.SQL, data, "documents")


def check(found, limit):
    by = defaultdict(list)
    for r in found:
        by[r.shard_id].append(r)
    for held in by.values():
        assert sum(r.n_bytes for r in held) == held[0].shard_bytes and len(held) == held[0].shard_docs
        assert held[0].shard_bytes <= limit or len(held) == 1
    return by


def test_only_oversized_buckets_split(spark, documents):
    docs = documents([(k, "x" * (k % 700)) for k in range(3000)])
    by = check(sharding.shard(docs, 5_000).collect(), 5_000)
    sums = {s: held[0].shard_bytes for s, held in by.items()}
    assert len(sums) > 100 and not any(a != b and b.startswith(a) for a in sums for b in sums if len(b) > len(a))
    for s in sums:  # the parent of each leaf would not fit
        assert not s or sum(v for k, v in sums.items() if k.startswith(s[:-1])) > 5_000


def test_copies_of_one_row_split_too(spark, documents):
    docs = documents([(1, "y" * 1000)] * 500 + [(2, "z" * 20_000), (3, None), (None, "")], addr="a", depth="d")
    found = sharding.shard(docs, 5_000).collect()
    assert len(found) == 503
    check(found, 5_000)


def test_empty(spark, documents):
    assert sharding.shard(documents([])).count() == 0
    assert [r.shard_id for r in sharding.shard(documents([(1, "one")])).collect()] == [""]


def test_written_shards(spark, documents, tmp_path):
    sharding.write_shards(documents([(k, "x" * 100) for k in range(200)]), f"{tmp_path}/out", 3_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 200 and back.select("shard_id").distinct().count() > 5


def test_large_copies_split_until_each_shard_fits(spark, documents):
    docs = documents([(1, "y" * 3000)] * 64 + [(2, "z" * 3000)] * 9 + [(3, "w")])
    found = sharding.shard(docs, 4_000).collect()
    assert len(found) == 74
    check(found, 4_000)


def test_each_row_is_written_once(spark, documents, tmp_path):
    rows = [(None, "n" * 100)] * 3 + [(7, "a" * 100), (7, "a" * 100), (7, "b" * 100)] + [(k, "x" * 100) for k in range(10, 40)]
    sharding.write_shards(documents(rows), f"{tmp_path}/out", 600)
    back = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(back, key=str) == sorted(rows, key=str)


def test_shards_of_a_table_that_has_a_shard_id(spark, documents, tmp_path):
    docs = documents([(k, "x" * 100) for k in range(60)], shard_id="mine", shard_row="r")
    name = sharding.write_shards(docs, f"{tmp_path}/out", 1_500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert name == "shard_id_" and back.count() == 60 and {r.shard_id for r in back.select("shard_id").collect()} == {"mine"}
    assert back.select(name).distinct().count() > 2
