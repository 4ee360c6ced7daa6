"""op9: the contract of shards and slots, splitters against sorting."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import functions as F

from kinframe.llm import queries, sharding


def check(rows, docs, shards=8):
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
    text = {d: t or "" for d, t in docs}
    group, sums = {}, [0] * shards
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert group.setdefault(text[r.doc_id], r.shard) == r.shard
        sums[r.shard] += r["size"]
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    return sums


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sums = check(queries.op9_sharding(spark, "/root/testdata/sf0.01").collect(), docs)
    largest = max(len(t.encode()) + 1 for _, t in docs)
    assert max(sums) - min(sums) <= 2 * largest


def test_hot_group_and_odd_rows(spark):
    rng = random.Random(1)
    docs = [(i, "hot text" * 50) for i in range(300)] + [(1000 + i, "t" * rng.randint(0, 900)) for i in range(500)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame([(*d, 7, 8, "x") for d in docs], "doc_id long, text string, shard int, size int, source string")
    got = sharding.shard(sharding.keyed_sizes(df, "text", "shard", "size", "source"))
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", *sharding.OUT])
    check(got.collect(), docs)
    assert sharding.shard(sharding.keyed_sizes(df.filter("false"))).count() == 0


def test_null_and_repeated_ids(spark):
    rows = sharding.shard(sharding.keyed_sizes(spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (1, "c"), (1, "d")], "doc_id long, text string")), shards=3).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in rows) == [(0, 2), (0, 2), (1, 2), (1, 2), (1, 2)]
    for s in range(3):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_splitters_are_close_to_even(spark):
    df = spark.range(20_000).select(F.xxhash64("id").alias("ukey"), (F.col("id") % 90 + 1).alias("size"))
    starts, rounds = sharding.splitters(df, 8, 0.001)
    rows = [(r.ukey % 2**64, r["size"]) for r in df.collect()]
    total = sum(s for _, s in rows)
    for j, start in enumerate(starts, 1):
        assert abs(sum(s for k, s in rows if k < start) - total * j / 8) <= max(0.001 * total / 8, 90)
    assert rounds <= 7


def test_the_query_moves_texts_and_reads_them_back(spark, monkeypatch):
    seen = []
    whole = sharding.shard
    monkeypatch.setattr(sharding, "shard", lambda docs, *a, **k: seen.append(whole(docs, *a, **k)) or seen[-1])
    rows = queries.op9_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert "text" in seen[0].columns
    assert {r.doc_id: r.text for r in seen[0].collect()} == texts
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows)


def test_digests_come_from_the_stored_text(spark):
    stored = spark.createDataFrame([(1, "é", 9, 9), (2, None, 9, 9)], "doc_id long, text string, size long, text_crc32 long")
    got = {r.doc_id: (r["size"], r.text_crc32) for r in sharding.measured(stored).collect()}
    assert got == {1: (3, zlib.crc32("é".encode())), 2: (1, 0)}
