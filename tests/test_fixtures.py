"""Tiny graphs with answers worked out by hand."""

import itertools
import random

import pytest

from loomgraph.graph import Graph
from loomgraph.operators import communities as C
from loomgraph.operators import construct, kernels
from loomgraph.operators import orderings as O
from loomgraph.plans import compose, gas

TINY = {
    "tiny": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)],
    "dangling": [(0, 1), (0, 2), (1, 2)],
    "disconnected": [(0, 1), (1, 2), (3, 4), (5, 6)],
    "isolated": [(0, 1), (1, 2), (4, 4)],
    "path": [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)],
    "star": [(0, k) for k in range(1, 7)],
}
#: edges after symmetrising, components, depths from 0, triangles, new ids by degree and by degree bucket, PageRank after ten rounds
WANT = {
    "tiny": (10, [0, 0, 0, 0], [0, 1, 1, 1], 2, [0, 2, 1, 3], [0, 2, 1, 3], [0.295058, 0.204942, 0.295058, 0.204942]),
    "dangling": (6, [0, 0, 0], [0, 1, 1], 1, [0, 1, 2], [0, 1, 2], [0.333333] * 3),
    "disconnected": (8, [0, 0, 0, 3, 3, 5, 5], [0, 1, 2] + [None] * 4, 0, [1, 0, 2, 3, 4, 5, 6], [1, 0, 2, 3, 4, 5, 6], [0.1165, 0.195572, 0.1165] + [0.142857] * 4),
    "isolated": (4, [0, 0, 0, 3, 4], [0, 1, 2, None, None], 0, [1, 0, 2, 3, 4], [0, 1, 2, 3, 4], [0.1631, 0.273801, 0.1631, 0.03, 0.03]),
    "path": (10, [0] * 6, [0, 1, 2, 3, 4, 5], 0, [4, 0, 1, 2, 3, 5], [4, 0, 1, 2, 3, 5], [0.110462, 0.198235, 0.191303, 0.191303, 0.198235, 0.110462]),
    "star": (12, [0] * 7, [0] + [1] * 6, 0, list(range(7)), list(range(7)), [0.406431] + [0.098928] * 6),
}
WEIGHTED = {
    "weighted": ([(0, 1, 1), (0, 2, 4), (1, 2, 2), (1, 3, 5), (2, 3, 1), (4, 5, 3)], [0, 1, 3, 4, None, None]),
    "isolated": ([(0, 1, 1), (1, 2, 2), (4, 4, 1)], [0, 1, 3, None, None]),
    "path": ([(k, k + 1, k + 1) for k in range(5)], [0, 1, 3, 6, 10, 15]),
    "star": ([(0, k, k) for k in range(1, 7)], [0, 1, 2, 3, 4, 5, 6]),
}


def graph(spark, rows, directed=False):
    df = spark.createDataFrame(rows, "src long, dst long" + (", weight long" if rows and len(rows[0]) == 3 else ""))
    return Graph.dense(df, directed).cut()


def values(df, key, value, n):
    got = {r[key]: r[value] for r in df.collect()}
    return [got.get(i) for i in range(n)]


@pytest.mark.parametrize("name", TINY)
def test_kernels(spark, name):
    g = graph(spark, TINY[name])
    edges, comps, depth, tri, by_degree, by_bucket, rank = WANT[name]
    n = len(comps)
    assert g.edges.count() == edges
    for f in (kernels.components, kernels.components_sv, gas.components):
        assert values(f(g), "id", "component", n) == comps
    assert values(kernels.bfs(g, 0), "id", "depth", n) == depth
    assert kernels.triangles(g).first()["total"] == tri
    assert values(O.by_degree(g), "old_id", "new_id", n) == by_degree
    assert values(O.degree_buckets(g), "old_id", "new_id", n) == by_bucket
    got = values(kernels.pagerank(g, 10, fixed_work=True)[0], "id", "score", n)
    assert got == pytest.approx(rank, abs=1e-6)
    assert values(gas.pagerank(g, 10, fixed_work=True), "id", "score", n) == pytest.approx(rank, abs=1e-6)


@pytest.mark.parametrize("name", WEIGHTED)
def test_distances(spark, name):
    rows, want = WEIGHTED[name]
    g = graph(spark, rows, True)
    assert values(kernels.sssp(g, 0), "id", "dist", len(want)) == want
    assert values(gas.sssp(g, 0), "id", "dist", len(want)) == want


def slow_betweenness(n, edges, sources):
    near = {v: sorted({d for s, d in edges if s == v}) for v in range(n)}
    score = [0.0] * n
    for s in sources:
        depth, paths, order = {s: 0}, {s: 1.0}, [s]
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w], paths[w] = depth[v] + 1, 0.0
                    order.append(w)
                if depth[w] == depth[v] + 1:
                    paths[w] += paths[v]
        delta = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            delta[v] = sum(paths[v] / paths[w] * (1 + delta[w]) for w in near[v] if depth.get(w) == depth[v] + 1)
            score[v] += delta[v]
    most = max(score)
    return [x / most for x in score] if most else score


def random_rows(seed, n=30, m=60):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def test_betweenness(spark):
    rows = random_rows(1)
    g = graph(spark, rows, True)
    n = g.vertices.count()
    got = values(kernels.betweenness(g, [0, 5]), "id", "score", n)
    assert got == pytest.approx(slow_betweenness(n, [r for r in rows if r[0] != r[1]], [0, 5]), abs=1e-9)


ORDERS = {
    "random": O.random, "degree": O.by_degree, "both": O.by_both_degrees, "hubs": O.hubs_sorted, "hubs_by_id": O.hubs_clustered, "buckets": O.degree_buckets,
    "hubs_packed": O.hubs_sorted_packed, "hot_cold": lambda g: O.hot_cold(g, 8), "forward": O.forward_fraction, "rcm": O.reverse_cuthill_mckee,
    "greedy": O.greedy_window, "rabbit": C.rabbit,
}


@pytest.mark.parametrize("name", ORDERS)
def test_orders_are_permutations_that_keep_answers(spark, name):
    g = graph(spark, random_rows(2, 40, 80))
    mapping = ORDERS[name](g)
    assert construct.is_bijection(mapping).first()["is_bijection"]
    assert compose.same_topology(g, mapping)
    if name not in ("degree", "rcm"):
        return
    there = construct.relabelled(g, mapping).cut()
    assert kernels.triangles(there).first() == kernels.triangles(g).first()
    place = {r["old_id"]: r["new_id"] for r in mapping.collect()}
    a = {r["id"]: r["score"] for r in kernels.pagerank(g, 5, fixed_work=True)[0].collect()}
    b = {r["id"]: r["score"] for r in kernels.pagerank(there, 5, fixed_work=True)[0].collect()}
    assert all(a[v] == pytest.approx(b[place[v]]) for v in a)


def test_hub_places_by_hand(spark):
    # degrees: 9 has 4, 5 has 3, the average is 1: hubs are 9, 5 and what else is above 1
    rows = [(9, 0), (9, 1), (9, 2), (9, 5), (5, 0), (5, 3)]
    g = graph(spark, rows)
    degree = {r["id"]: r["out_degree"] for r in construct.degrees(g).collect()}
    hubs = sorted((v for v in degree if degree[v] > O.average_degree(g)), key=lambda v: (-degree[v], -v))
    got = {r["old_id"]: r["new_id"] for r in O.hubs_sorted(g).collect()}
    assert [got[h] for h in hubs] == list(range(len(hubs)))
    beyond = [v for v in degree if v >= len(hubs) and v not in hubs]
    assert all(got[v] == v for v in beyond) and sorted(got.values()) == list(range(10))


def two_cliques(spark, k=6):
    rows = [(a, b) for a, b in itertools.combinations(range(k), 2)] + [(a + k, b + k) for a, b in itertools.combinations(range(k), 2)] + [(0, k)]
    return graph(spark, rows)


@pytest.mark.parametrize("name", ["leiden", "louvain", "lp", "rabbit"])
def test_communities_of_two_cliques(spark, name):
    g = two_cliques(spark)
    build = {"leiden": lambda: C.leiden(g, 1.0), "louvain": lambda: C.louvain(g, 1.0)[0], "lp": lambda: C.label_propagation(g), "rabbit": lambda: C.incremental_aggregation(g)}[name]
    got = values(build(), "id", "community", 12)
    assert len(set(got[:6])) == 1 and len(set(got[6:])) == 1 and got[0] != got[6]
    assert C.disconnected(g, build().select("id", "community")).count() == 0


def test_small_communities_are_merged(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (5, 6)])
    member = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 5), (6, 5)], "id long, community long")
    got = values(C.merged_small(g, member, 2), "id", "community", 7)
    assert got == [0, 0, 0, 0, 0, 5, 5] or got[3] == got[4]


def test_sources_are_checked(spark):
    g = graph(spark, TINY["isolated"])
    assert kernels.checked_sources(g, [0, 2]) == [0, 2]
    for bad in ([0, 0], [3], [99]):
        with pytest.raises(ValueError):
            kernels.checked_sources(g, bad)


def test_same_with_any_number_of_partitions(spark):
    rows = random_rows(4, 50, 120)
    got = []
    for n in ("1", "4", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        g = graph(spark, rows)
        got.append((sorted(map(tuple, O.hubs_sorted(g).collect())), sorted(map(tuple, kernels.components(g).collect())), sorted(map(tuple, O.greedy_window(g).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]


def test_batches(spark):
    g = graph(spark, TINY["path"])
    new = spark.createDataFrame([(0, 5, 3), (0, 1, 7), (2, 2, 1)], "src long, dst long, weight long")
    gone = spark.createDataFrame([(1, 2)], "src long, dst long")
    got = {(r["src"], r["dst"]): r["weight"] for r in construct.applied_batch(g, gone, new).edges.collect()}
    assert got[0, 5] == got[5, 0] == 3 and got[0, 1] == 7 and (1, 2) not in got and (2, 1) not in got and (2, 2) not in got
    assert construct.without_vertices(g, spark.createDataFrame([(2,)], "id long")).edges.count() == 6


def test_empty_graph(spark):
    g = graph(spark, [])
    assert g.vertices.count() == 0 and O.by_degree(g).count() == 0 and kernels.components(g).count() == 0
    assert kernels.pagerank(g, 3)[0].count() == 0 and kernels.triangles(g).first()["total"] == 0
