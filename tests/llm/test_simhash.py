import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import simhash as S


def slow_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, seed=42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(parts))


def slow_components(prints):
    """prints: list of (id, fingerprint); the smallest id reachable for each row."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(1)
    masks = S.masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        differing = sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(differing & m & (1 << 64) - 1 == 0 for m in masks)


@pytest.mark.parametrize("bucket", [4096, 3])
def test_query_against_brute_force(spark, sf, bucket):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(docs, bucket=bucket).collect()}
    prints = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
    assert got == {(d, f"{f:016x}", c) for (d, f), c in zip(prints, slow_components(prints))}


@pytest.mark.parametrize("bucket", [4096, 5])
def test_dense_and_chained_fingerprints(spark, bucket):
    rng = np.random.default_rng(3)
    values = set()
    for _ in range(4):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(12):  # chains: each within the radius of the one before
            x ^= sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            values.add(x)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    uniq = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = [(r["src"], r["dst"]) for r in S.link(uniq, bucket=bucket).collect()]
    parent = {v: v for v in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    want = slow_components([(v, v & (1 << 64) - 1) for v in signed])
    groups = {}
    for v, w in zip(signed, want):
        groups.setdefault(find(v), set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_odd_rows(odd_docs, no_docs):
    rows = S.near_duplicates(odd_docs).collect()
    assert len(rows) == 11
    got = {(r["doc_id"], r["component_id"]) for r in rows}
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (4, 4), (5, 4), (6, 4)} <= got and (None, None) in got
    assert S.near_duplicates(no_docs).collect() == []


def test_keep_one(odd_docs, no_docs):
    kept = S.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == [1, 4, 7, 8, None]
    repeated = odd_docs.where("doc_id = 5")
    assert [r["doc_id"] for r in S.keep_one(repeated).collect()] == [5]
    assert S.keep_one(no_docs).count() == 0
    assert kept.where(F.col("doc_id") == 4).first()["component_id"] == "q"


def test_hot_buckets_are_divided_without_losing_links(spark):
    """Fingerprints that share most bits: buckets stay large through both covering families."""
    rng = np.random.default_rng(8)
    fps = {int(x) for x in (rng.integers(0, 1 << 62, 1)[0] ^ rng.integers(0, 1 << 9, 400))} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    uniq = spark.createDataFrame([(x,) for x in fps], "fp long")
    for bucket in (2, 40):
        edges = [(r["src"], r["dst"]) for r in S.link(uniq, bucket=bucket).collect()]
        near = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
        assert groups(fps, edges) == groups(fps, near)


def groups(items, edges):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for x in items:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))
