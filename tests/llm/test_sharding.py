import zlib

import pytest

from loomgraph.llm import sharding as S


def check(rows, shards=8):
    total = sum(r["size"] for r in rows)
    bytes_, slots = {}, {}
    for r in rows:
        bytes_[r["shard"]] = bytes_.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    most = max(r["size"] for r in rows)
    assert all(0 <= s < shards for s in bytes_)
    assert all(abs(bytes_.get(s, 0) - total / shards) <= most + 1 for s in range(shards))


def test_query(spark, sf):
    rows = S.op4_sharding(spark, sf).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    check(rows)


def test_hot_text_is_subdivided(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the same text', concat('text ', repeat('x', int(id % 50)), id)) as text")
    keyed = docs.selectExpr("xxhash64(text) as __h", "doc_id as __id", "cast(length(text) + 1 as long) as __size")
    bounds = S.splitters(keyed, 64)
    sizes = keyed.withColumn("r", S.range_of(bounds, keyed["__h"], keyed["__id"])).groupBy("r").sum("__size").collect()
    mean = sum(r[1] for r in sizes) / 64
    assert max(r[1] for r in sizes) <= 2 * S.OVERFULL * mean
    check(S.shard_by_splitters(docs, keep=("doc_id",)).collect())


def test_odd_rows(odd_docs, no_docs):
    rows = S.shard_by_splitters(odd_docs, shards=2)
    assert set(odd_docs.columns) <= set(rows.columns) and len(rows.columns) == len(set(rows.columns))
    rows = rows.collect()
    assert len(rows) == 11
    check(rows, 2)
    assert S.shard_by_splitters(no_docs).count() == 0


@pytest.mark.parametrize("n", [1, 2])
def test_fewer_rows_than_shards(spark, n):
    rows = S.shard_by_splitters(spark.range(n).selectExpr("id as doc_id", "'t' as text")).collect()
    assert len(rows) == n and all(r["slot"] == 0 or n == 2 for r in rows)
