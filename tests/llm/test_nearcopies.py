import random

import numpy as np
import pytest

import corpus_pipeline as C
from loomgraph.llm import nearcopies as N


def slow_least(rows):
    """rows: (id, text); the smallest id reachable over pairs of Jaccard 0.8 or more, for each id."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def edited():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rng.randrange(20, 200))] + rng.choice([[], passage])
        for _ in range(6):
            at = base[:]
            for _ in range(rng.randrange(8)):
                at[rng.randrange(len(at))] = word()
            rows.append(" ".join(at))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("rounds", [6, 0])
def test_near_copies_against_brute_force(spark, rounds):
    rows = edited()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in N.near_copies(docs, rounds=rounds).collect()}
    assert got == slow_least(rows) and len(set(got.values())) < len(rows)


def test_sketches_never_differ_by_more_than_the_sets():
    rng = random.Random(3)
    for n in (0, 1, 50, 3000):
        a = {rng.randrange(1 << 64) for _ in range(n)}
        b = {x for x in a if rng.random() < 0.9} | {rng.randrange(1 << 64) for _ in range(n // 9)}
        x, y = (N.parity_of(np.array(sorted(s), "<u8")) for s in (a, b))
        assert x.size == N.SKETCH and int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(a ^ b)


def test_stage_drops_copies_of_ordinary_edit_size(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id in (1, 177)")
    want = slow_least([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert set(want.values()) == {1}  # similarity 0.83, but 9 bits of the fingerprints differ
    assert [r["doc_id"] for r in C.drop_near_copies(spark, docs, sf).collect()] == [1]


def test_a_part_is_verified_by_two_queries(spark, monkeypatch):
    """The driver keeps what the last thousand queries were, so their number is part of its memory."""

    def ran():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()

    rows, seen, parts, similar, batches = edited(), [], [], N._similar, N._batches

    def counted(*args):
        parts.append(batches(*args))
        return parts[-1]

    def watched(*args):
        at, held = ran(), len(parts)
        out = similar(*args)
        if parts[held:] and parts[-1] > 4:
            seen.append((ran() - at, parts[-1]))
        return out

    monkeypatch.setattr(N, "FEW", 0)
    monkeypatch.setattr(N, "_batches", counted)
    monkeypatch.setattr(N, "_similar", watched)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(docs).collect()} == slow_least(rows)
    assert seen and all(queries <= 2 * n + 6 for queries, n in seen)


def test_wide_sketches_leave_similar_pairs_only(spark):
    """Sets of over 600 shingles all passed the sketches of 256 bits."""
    rng = random.Random(5)
    sets = []
    for n in (60, 700, 1500, 4000):
        base = [rng.randrange(1 << 64) for _ in range(n)]
        sets += [set(base[: int(n * keep)]) | {rng.randrange(1 << 64) for _ in range(new)} for keep, new in ((1, 0), (0.9, n // 20), (0.96, n // 9), (0.7, n // 3), (0, n))]
    made = [np.array(sorted(s), "<u8") for s in sets]
    reps = spark.createDataFrame([(i, x.size, N.wide_of(x).tolist()) for i, x in enumerate(made)], "sid long, n int, w array<long>")
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j]
    got = {(r["src"], r["dst"]) for r in N._near(spark.createDataFrame(pairs, "src long, dst long"), reps).collect()}
    like = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert {x for x in pairs if like(*x) >= 0.8} <= got and all(like(*x) > 0.6 for x in got)
    assert any(N.wide_of(made[i]).size != N.wide_of(made[j]).size for i, j in got)


def test_pairs_verified_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    """Of a group of near copies all pairs across components went to be verified."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(100_000)}"
    base, rows, verified, batches = [word() for _ in range(200)], [], [], N._batches
    for i in range(120):
        at = base[:]
        for _ in range(2):
            at[rng.randrange(len(at))] = word()
        rows.append((i, " ".join(at)))

    def counted(n, *args):
        verified.append(n)
        return batches(n, *args)

    monkeypatch.setattr(N, "_batches", counted)
    monkeypatch.setattr(N, "FEW", 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(docs, rounds=0).collect()} == slow_least(rows)
    assert 0 < sum(verified) <= 6 * len(rows)


@pytest.mark.parametrize("local", [250_000, 100])
def test_forest_spans_the_components_by_the_likeliest_pairs(spark, monkeypatch, local):
    rng = random.Random(23)
    rows = [(2 * i, 2 * i + 1, rng.randrange(40), 40 + rng.randrange(40), rng.random()) for i in range(1500)]
    rows += [(9000 + i, 9100 + i, 100 + i, 101 + i, 0.5) for i in range(3)]
    monkeypatch.setattr(N, "LOCAL", local)
    got = [tuple(r) for r in N._forest(spark.createDataFrame(rows, "src long, dst long, u long, v long, far double").repartition(4), len(rows)).collect()]
    u, v, far = (np.array([r[k] for r in rows]) for k in (2, 3, 4))
    least = {rows[i] for i in N.spanning(u, v, far)}
    assert len(least) == 82 and least <= set(got) <= set(rows)
    assert local == 100 or set(got) == least
