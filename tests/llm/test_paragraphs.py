import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import paragraphs as P


def pieces(text):
    out = set()
    for p in re.split(r"\n|(?<=[a-n][.!?])", text):
        out.update(p[i : i + 256] for i in range(0, len(p), 256))
    return out


def slow(docs):
    """docs: (id, text) in order. What the query is to return but for the fingerprints."""
    out = {}
    for k, (i, t) in enumerate(docs):
        n = len(t) // 4
        nxt = docs[(k + 1) % len(docs)][1]
        e = t[: len(t) - n] + nxt[:n]
        a, b, c = pieces(t), pieces(e), pieces(nxt)
        like = lambda x, y: 1.0 - len(x ^ y) / (len(x) + len(y)) if x or y else 1.0
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), like(a, b), like(a, c))
    return out


@pytest.mark.parametrize("parts", [1, 4])
def test_query_against_brute_force(spark, sf, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = P.op2_fingerprints(spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = slow(docs)
    assert len(rows) == len(docs)
    for r in rows:
        n, sha, edited, nxt = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert r["near_edited"] == pytest.approx(edited, abs=1e-12) and r["near_next"] == pytest.approx(nxt, abs=1e-12)
    prints, texts = {}, dict(docs)
    for r in rows:
        assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) == len({frozenset(pieces(t)) for t in prints})


@pytest.mark.parametrize("size", [0, 1, 5, 40, 300])
def test_differing_digests_are_counted(spark, size):
    df = spark.range(30).selectExpr("id", f"transform(sequence(1, 20), i -> xxhash64(i, 1)) as common", f"if({size} = 0, array(), transform(sequence(1, {max(1, size)}), i -> xxhash64(id, i))) as own")
    df = df.selectExpr("concat(common, cast(own as array<bigint>)) as a", "slice(common, 1, 17) as b")
    df = df.withColumns({"ca": F.expr(P.cells(P.entries("a", 1, P.BASE), P.BASE)), "cb": F.expr(P.cells(P.entries("b", 1, P.BASE), P.BASE))})
    got = {r[0] for r in df.select(F.size(F.expr(P.differing("a", "b", "ca", "cb")))).collect()}
    assert got == {size + 3}


def test_failed_peeling_is_null(spark):
    df = spark.range(1).selectExpr("transform(sequence(1, 100), i -> xxhash64(i)) as a")
    sketch = P.cells(P.entries("a", 1, 24), 24)
    assert df.select(F.expr(P.peeled(sketch, 24))).first()[0] is None
    assert df.select(F.expr(P.peeled(P.cells(P.entries("slice(a, 1, 6)", 1, 24), 24), 24))).first()[0].__len__() == 6


def test_odd_rows(spark, odd_docs, no_docs):
    rows = P.fingerprint_versions(odd_docs).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_chars"] == 0 and by[1]["near_next"] == 1.0 and by[1]["fingerprint"] == by[2]["fingerprint"]
    assert by[5]["fingerprint"] == by[4]["fingerprint"] and by[4]["near_next"] == 1.0
    assert by[8]["near_next"] == 0.0 and by[7]["n_chars"] > 100_000
    assert P.fingerprint_versions(no_docs).collect() == []
    one = P.fingerprint_versions(spark.createDataFrame([(3, "abcdefgh")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_recovered_digests(spark):
    """The digests that the sketches give back are those of the pieces that differ."""
    texts = [(i, "\n".join(f"line {j} of {i % 7}" for j in range(5 + 9 * i))) for i in range(25)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for r in P.fingerprint_versions(docs).collect():
        t, nxt = texts[r["doc_id"]][1], texts[(r["doc_id"] + 1) % len(texts)][1]
        n = len(t) // 4
        a, b = pieces(t), pieces(t[: len(t) - n] + nxt[:n])
        hashes = {h[1]: h[0] for h in spark.createDataFrame([(x,) for x in a | b], "p string").selectExpr("p", "xxhash64(p)").collect()}
        assert {hashes[d] for d in r["removed"]} == a - b and {hashes[d] for d in r["added"]} == b - a


def test_likeness_follows_the_share_changed(spark):
    words = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(6000)]
    text = " ".join(w + "." * (i % 7 == 6) for i, w in enumerate(words))
    near = []
    for share in (0, 0.01, 0.1, 0.25, 0.5, 1):
        other = words[:200] + ["inserted"] + [w if i >= share * 5800 else w[::-1] + "x" for i, w in enumerate(words[200:])]
        docs = spark.createDataFrame([(1, text), (2, " ".join(w + "." * (i % 7 == 6) for i, w in enumerate(other[:200] + other[201:])))], "doc_id long, text string")
        near.append(P.fingerprint_versions(docs).where("doc_id = 1").first()["near_next"])
    assert near[0] == 1 and all(abs(n - (1 - s)) < 0.12 for n, s in zip(near, (0, 0.01, 0.1, 0.25, 0.5, 1)))
    moved = spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")
    assert P.fingerprint_versions(moved).where("doc_id = 1").first()["near_next"] > 0.97


def test_many_short_lines_take_time_in_proportion(spark):
    took = {}
    for lines in (500, 3_000, 48_000):
        docs = spark.createDataFrame([(k, "\n".join(f"{k} {i}" for i in range(lines))) for k in range(2)], "doc_id long, text string").coalesce(1)
        began = time.perf_counter()
        rows = P.fingerprint_versions(docs).select("near_next").collect()
        took[lines] = time.perf_counter() - began
        assert [r[0] for r in rows] == [0.0, 0.0]
    assert took[48_000] < 40 * took[3_000]


def test_ranges_by_binary_search(spark):
    for bounds in ([], [5], [-3, 0, 7], list(range(0, 1000, 7))):
        got = spark.range(-10, 1010).selectExpr("id", f"{P._bucket(bounds, 'id')} as b").collect()
        assert all(r["b"] == sum(x <= r["id"] for x in bounds) for r in got)
