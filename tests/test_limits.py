"""No result is cut short: loops that run out of steps say so, and large components are merged like small ones."""

import random
import tracemalloc

import numpy as np
import pytest

from loomgraph import runtime
from loomgraph.functions import features
from loomgraph.graph import Graph
from loomgraph.operators import communities, kernels
from loomgraph.operators.components import connected_components
from loomgraph.plans import gas
from loomgraph.runtime import cut, cut_flat, ensure_checkpoint_dir, release


def chain(spark, n):
    return Graph.from_edges(spark.range(n).selectExpr("id as src", "id + 1 as dst"), directed=False)


def test_supersteps_that_do_not_settle_are_an_error(spark):
    g = chain(spark, 9).cut()
    with pytest.raises(RuntimeError, match="not settled"):
        gas.run(g, gas.ComponentProgram(), max_steps=3)
    state, log = gas.run(g, gas.ComponentProgram(), max_steps=20)
    assert {r["state"] for r in state.collect()} == {0}
    assert log[0].edges == 18 and all(s.edges > 0 for s in log) and log[-1].active == 0
    assert [s.edges for s in log][1] < 18  # only what changed is read from


def test_large_components_are_merged_too(spark):
    cliques = [(10 * k + i, 10 * k + j) for k in range(6) for i in range(6) for j in range(i)] + [(10 * k, 10 * k + 10) for k in range(5)]
    g = Graph.from_edges(spark.createDataFrame(cliques, "src long, dst long"), directed=False).cut()
    rows = communities.incremental_aggregation(g, limit=5).collect()
    assert len({r["id"] for r in rows}) == len(rows) == 36 and sorted(r["place"] for r in rows) == list(range(36))
    groups = {}
    for r in rows:
        groups.setdefault(r["community"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[10 * k + i for i in range(6)] for k in range(6)]


def test_released_tables_are_gone(spark):
    ensure_checkpoint_dir(spark)
    for make in (cut, cut_flat):
        done = make(spark.range(10))
        assert done.count() == 10
        release(done, None)
        with pytest.raises(Exception):  # noqa: B017
            done.count()


def test_components_by_tasks_and_by_rounds_are_the_same(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-150, 150, (130, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7), (None, 3), (2000, -3), (2000, -3)]
    root = {}

    def least(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            a, b = least(a), least(b)
            root[max(a, b)] = min(a, b)
    want = sorted((x, least(x)) for x in root)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for local in (1_000_000, 40, 9):
        assert sorted(map(tuple, connected_components(edges, local=local).collect())) == want
    assert connected_components(edges.limit(0)).count() == 0
    # other types go by the rounds alone
    assert connected_components(edges.selectExpr("cast(src as int) src", "cast(dst as int) dst")).count() == len(want)


def _triangle_fixture(spark):
    """A graph with hubs, negative ids and the triangles of each tile (3 by 2), by hand."""
    rng = random.Random(5)
    pairs = ((rng.randrange(60) ** 2 // 40 - 20, rng.randrange(90) - 20) for _ in range(900))
    edges = {(min(a, b), max(a, b)) for a, b in pairs if a != b}
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want: dict[int, int] = {}
    for a, b in edges:
        for c in (c for c in near[a] & near[b] if c > b):
            u, *rest = sorted((a, b, c), key=lambda v: (len(near[v]), v))
            tile = u % 3 * 2 + min(rest) % 2
            want[tile] = want.get(tile, 0) + 1
    return Graph.from_edges(spark.createDataFrame(list(edges), "src long, dst long"), directed=False), want


def test_triangles_in_turns_over_ranges(spark):
    g, want = _triangle_fixture(spark)
    assert kernels.triangles(g, block=30).first()["total"] == sum(want.values()) > 1000


def test_tiles_in_turns_over_ranges(spark):
    g, want = _triangle_fixture(spark)
    assert {r["tile"]: r["triangles"] for r in kernels.triangles_by_tile(g, 3, 2, block=30).collect()} == want


def test_extended_features_by_hand(spark):
    edges = [(1, 2), (1, 3), (2, 3), (3, 9), (5, 9), (1, 9)]
    both = sorted(edges + [(b, a) for a, b in edges])
    seen: dict[int, int] = {}
    gaps = []
    for at, (_, dst) in enumerate(both):
        gaps += [at - seen[dst]] if dst in seen else []
        seen[dst] = at
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), directed=False).flat()
    row = features.extended(g).first()
    assert row["mean_reuse"] == pytest.approx(sum(gaps) / len(gaps)) and row["forward_share"] == 0.5
    assert row["clustering"] == pytest.approx(3 * 2 / 10)  # triangles 1-2-3 and 1-3-9; wedges 3 + 1 + 3 + 0 + 3


def test_one_large_clique_merges_in_little_memory():
    n = 1500
    dst = np.tile(np.arange(n, dtype=np.int32), n)[~np.eye(n, dtype=bool).ravel()]
    weight = np.ones(dst.size)
    tracemalloc.start()
    v, r = communities._merged(np.arange(n), np.full(n, n - 1), dst, weight, float(dst.size))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(v.tolist()) == list(range(n)) and len(set(r.tolist())) == 1
    assert most < 40 * dst.size  # tables of Python numbers took some 100 bytes an edge


def test_release_gives_freed_native_memory_back(spark, monkeypatch):
    assert runtime.trim(spark.sparkContext)
    asked = []
    monkeypatch.setattr(runtime, "trim", asked.append)
    monkeypatch.setattr(runtime, "_swept", -runtime.SWEEP)
    release(cut_flat(spark.range(3)), cut_flat(spark.range(3)))
    assert asked == [spark.sparkContext]  # once a sweep
