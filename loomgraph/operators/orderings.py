"""Vertex orderings: (old_id, new_id) bijections.

Those that are a sort by degree are one distributed numbering. Those that visit
vertices greedily run per component or community in a pandas function; a group of
more than GREEDY vertices takes the distributed order of the same kind instead.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, numbered
from loomgraph.operators.construct import degrees
from loomgraph.runtime import by_value, cut

#: Vertices of a group that one task orders greedily.
GREEDY = 200_000
SEGMENT = 1024


def _place(df: DataFrame, *order: Column) -> DataFrame:
    return numbered(df, *order).select(F.col("id").alias("old_id"), "new_id")


def original(g: Graph) -> DataFrame:
    return g.vertices.select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))


def random(g: Graph, seed: int = 0) -> DataFrame:
    """By the hash of seed and id: uniform and repeatable, not a sequential shuffle's order."""
    return _place(g.vertices, F.xxhash64(F.lit(seed), "id"), F.col("id"))


def by_degree(g: Graph, ascending: bool = False) -> DataFrame:
    """Out-degree, greatest first; ties by id."""
    d = F.col("out_degree")
    return _place(degrees(g), d.asc() if ascending else d.desc(), F.col("id"))


def by_both_degrees(g: Graph) -> DataFrame:
    """(out-degree, in-degree) greatest first, vertices without edges last by id."""
    none = (F.col("out_degree") + F.col("in_degree") == 0).cast("int")
    return _place(degrees(g), none, F.desc("out_degree"), F.desc("in_degree"), F.col("id"))


def average_degree(g: Graph) -> int:
    """Directed edges over vertices, as an integer."""
    n = g.vertices.count()
    return g.edges.count() // n if n else 0


def bucket(degree: Column, average: int) -> Column:
    """The log-like degree bucket, 0 for the least: the first of average/2, average, 2x .. 32x that the degree is not above."""
    limits = [average // 2] + [average << k for k in range(6)]
    out = F.lit(len(limits))
    for i, t in reversed(list(enumerate(limits))):
        out = F.when(degree <= t, i).otherwise(out)
    return out


def degree_buckets(g: Graph) -> DataFrame:
    """Buckets from the greatest degrees down; within one by id."""
    return _place(degrees(g), bucket(F.col("out_degree"), average_degree(g)).desc(), F.col("id"))


def _hubs(g: Graph) -> DataFrame:
    return degrees(g).withColumn("hub", F.col("out_degree") > average_degree(g))


def hubs_sorted_packed(g: Graph) -> DataFrame:
    """Hubs by (degree, id) descending, then the others by id."""
    d = _hubs(g)
    return _place(d, F.desc("hub"), F.when(F.col("hub"), F.col("out_degree")).desc(), F.when(F.col("hub"), -F.col("id")).otherwise(F.col("id")))


def hubs_clustered_packed(g: Graph) -> DataFrame:
    """Hubs by id, then the others by id."""
    return _place(_hubs(g), F.desc("hub"), F.col("id"))


def _displaced(ranked: DataFrame) -> DataFrame:
    """ranked (id, rank of hubs else null): hubs take the first places in rank order. Another vertex
    keeps its place beyond those; one whose place a hub took moves to that hub's old place if
    that is beyond, and the rest share the places still free, both in ascending order."""
    hubs = cut(ranked.where("rank is not null").select("id", "rank"))
    n = hubs.count()
    stays = ranked.where(F.col("rank").isNull() & (F.col("id") >= n)).select("id", F.col("id").alias("at"))
    lost = ranked.where(F.col("rank").isNull() & (F.col("id") < n)).select("id")
    gone = hubs.where(F.col("id") >= n).select(F.col("id").alias("at"), F.col("rank").alias("id"))
    swapped = cut(gone.join(lost, "id").select("id", "at"))
    free = numbered(gone.join(swapped.select("at"), "at", "left_anti").select("at"), F.col("at"), name="k")
    left = numbered(lost.join(swapped.select("id"), "id", "left_anti"), F.col("id"), name="k")
    shared = left.join(free, "k").select("id", "at")
    rest = stays.union(swapped).union(shared)
    return hubs.select(F.col("id").alias("old_id"), F.col("rank").alias("new_id")).union(rest)


def hubs_sorted(g: Graph) -> DataFrame:
    """Hubs by (degree, id) descending in the first places; the others keep theirs where they can. Ids must be 0..n-1."""
    d = _hubs(g)
    hubs = numbered(d.where("hub"), F.desc("out_degree"), F.desc("id"), name="rank").select("id", "rank")
    return _displaced(d.select("id").join(hubs, "id", "left"))


def hubs_clustered(g: Graph) -> DataFrame:
    """Hubs by id in the first places; the others keep theirs where they can. Ids must be 0..n-1."""
    d = _hubs(g)
    hubs = numbered(d.where("hub"), F.col("id"), name="rank").select("id", "rank")
    return _displaced(d.select("id").join(hubs, "id", "left"))


def hot_cold(g: Graph, segment: int = SEGMENT, directed_average: bool = False) -> DataFrame:
    """Segments of `segment` places, each with the same quota of hot vertices (degree above the
    average) in front, then cold ones, both by id; what fills no whole segment comes last, hot
    ones first. The average is over edges, an undirected one counted once, unless directed_average."""
    average = average_degree(g)
    if not g.directed and not directed_average:
        n_ = g.vertices.count()
        average = g.edges.count() // 2 // n_ if n_ else 0
    d = degrees(g).withColumn("hot", F.col("out_degree") > average)
    hot = cut(numbered(d.where("hot"), F.col("id"), name="r").select("id", "r", "hot"))
    cold = cut(numbered(d.where(~F.col("hot")), F.col("id"), name="r").select("id", "r", "hot"))
    n_hot, n_cold = hot.count(), cold.count()
    segments = max(1, -(-(n_hot + n_cold) // segment))
    quota = -(-n_hot // segments)
    rest = segment - quota
    whole = min(segments - 1, n_hot // quota if quota else segments, n_cold // rest if rest else segments)
    at = F.when(F.col("hot"), F.floor(F.col("r") / max(1, quota))).otherwise(F.floor(F.col("r") / max(1, rest)))
    return _place(hot.union(cold), F.least(at, F.lit(whole)), F.desc("hot"), F.col("r"))


def forward_fraction(g: Graph, rounds: int = 3) -> DataFrame:
    """Some rounds of sorting by the share of a vertex's out-edges that point forward (one half without
    any), then by out-degree, both descending, then by id."""
    place, d = original(g), cut(degrees(g).select("id", "out_degree"))
    for _ in range(rounds):
        a = place.select(F.col("old_id").alias("src"), F.col("new_id").alias("ps"))
        b = place.select(F.col("old_id").alias("dst"), F.col("new_id").alias("pd"))
        ahead = g.edges.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.avg((F.col("pd") > F.col("ps")).cast("double")).alias("s"))
        rows = d.join(ahead, "id", "left").select("id", "out_degree", F.coalesce("s", F.lit(0.5)).alias("s"))
        place = cut(_place(rows, F.desc("s"), F.desc("out_degree"), F.col("id")))
    return place


def read_mapping(mapping: DataFrame, g: Graph) -> DataFrame:
    """A given permutation (old_id, new_id), refused unless it is a bijection over the graph's vertices."""
    from loomgraph.operators.construct import is_bijection

    row = is_bijection(mapping).first()
    strange = mapping.join(g.vertices, mapping["old_id"] == g.vertices["id"], "left_anti")
    if not row["is_bijection"] or row["n"] != g.vertices.count() or not strange.isEmpty():
        raise ValueError("not a permutation of the graph's vertices")
    return mapping.select("old_id", "new_id")


def grouped(g: Graph, membership: DataFrame, order: Callable[[list[int], dict[int, list[int]]], list[int]], limit: int = GREEDY) -> DataFrame:
    """(id, community, local): order(vertices, neighbours) is applied to each community by one task.

    Rows of a task are the edges inside the community and its vertices. A community of
    more than `limit` vertices is ordered by degree, in the distributed way.
    """
    sizes = membership.groupBy("community").agg(F.count("*").alias("size"))
    marked = membership.join(sizes, "community")
    a = marked.select(F.col("id").alias("src"), "community", "size")
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    inside = g.edges.select("src", "dst").join(a, "src").join(b, "dst").where("community = cd")
    rows = inside.where(F.col("size") <= limit).select("community", "src", "dst")
    rows = rows.union(marked.where(F.col("size") <= limit).select("community", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for s, d in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            own = near.setdefault(int(s), [])
            if d == d and d is not None:
                own.append(int(d))
        near = {v: sorted(set(x)) for v, x in sorted(near.items())}
        done = order(list(near), near)
        return pd.DataFrame({"id": done, "community": pdf["community"].iloc[0], "local": range(len(done))})

    small = rows.groupBy("community").applyInPandas(run, "id long, community long, local long")
    large = marked.where(F.col("size") > limit).join(degrees(g).select("id", "out_degree"), "id")
    if large.isEmpty():
        return small
    first = large.groupBy("community").agg(F.lit(0).alias("z"))
    all_ = numbered(large, F.col("community"), F.desc("out_degree"), F.col("id"), name="at")
    start = all_.groupBy("community").agg(F.min("at").alias("from"))
    return small.union(all_.join(F.broadcast(start.join(first, "community")), "community").select("id", "community", (F.col("at") - F.col("from")).alias("local")))


def assembled(local: DataFrame, rank: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(old_id, new_id) from (id, community, local) and the communities' order (community, rank);
    isolated (id) go last by id."""
    sizes = local.groupBy("community").agg(F.count("*").alias("size"))
    rows = local.join(rank, "community").select("id", "rank", "local", F.lit(0).alias("last"))
    if isolated is not None:
        rows = rows.join(isolated, "id", "left_anti").union(isolated.select("id", F.lit(0), F.col("id"), F.lit(1)))
    _ = sizes
    return _place(rows, F.col("last"), F.col("rank"), F.col("local"), F.col("id"))


def cuthill_mckee(ids: list[int], near: dict[int, list[int]]) -> list[int]:
    """Breadth-first from a far end, neighbours by degree, the whole reversed. Several
    components: each from its vertex of least degree."""
    degree = {v: len(near[v]) for v in ids}
    seen: set[int] = set()
    out: list[int] = []

    def walk(start: int) -> list[int]:
        order, have, i = [start], {start}, 0
        while i < len(order):
            for w in sorted((w for w in near[order[i]] if w not in have), key=lambda w: (degree[w], w)):
                have.add(w)
                order.append(w)
            i += 1
        return order

    for v in sorted(ids, key=lambda v: (degree[v], v)):
        if v not in seen:
            first = walk(v)
            order = walk(first[-1])  # from the farthest vertex of a first sweep
            seen.update(order)
            out += order
    return out[::-1]


def hub_first_search(ids: list[int], near: dict[int, list[int]]) -> list[int]:
    """Breadth-first from the vertex of the greatest degree; what it does not reach follows by id."""
    if not ids:
        return []
    root = max(ids, key=lambda v: (len(near[v]), -v))
    order, have, i = [root], {root}, 0
    while i < len(order):
        for w in near[order[i]]:
            if w not in have:
                have.add(w)
                order.append(w)
        i += 1
    return order + [v for v in ids if v not in have]


def window_greedy(window: int = 5, two_hop: bool = True, limit: int = 5_000) -> Callable[[list[int], dict[int, list[int]]], list[int]]:
    """Places next the vertex that shares most edges, and (two_hop) neighbours, with the last
    `window` placed; ties by the smaller id. Above `limit` vertices: a search from the hub."""

    def order(ids: list[int], near: dict[int, list[int]]) -> list[int]:
        if len(ids) > limit:
            return hub_first_search(ids, near)
        import heapq

        score = dict.fromkeys(ids, 0)
        heap = [(0, v) for v in ids]
        heapq.heapify(heap)
        out: list[int] = []
        placed: set[int] = set()
        hub = max(1, int(len(ids) ** 0.5))

        def change(v: int, by: int) -> None:
            touched = list(near[v])
            if two_hop:
                for u in near[v]:
                    if len(near[u]) <= hub:
                        touched += near[u]
            for w in touched:
                if w not in placed:
                    score[w] += by
                    heapq.heappush(heap, (-score[w], w))

        current = max(ids, key=lambda v: (len(near[v]), -v)) if ids else None
        while current is not None:
            out.append(current)
            placed.add(current)
            change(current, 1)
            if len(out) > window:
                change(out[-window - 1], -1)
            current = None
            while heap:
                s, v = heapq.heappop(heap)
                if v not in placed and -s == score[v]:
                    current = v
                    break
        return out

    return order


def reverse_cuthill_mckee(g: Graph) -> DataFrame:
    """Component by component (the largest last); each by cuthill_mckee."""
    from loomgraph.operators.kernels import components

    label = cut(components(g).withColumnRenamed("component", "community"))
    local = grouped(g, label, cuthill_mckee)
    sizes = label.groupBy("community").agg(F.count("*").alias("size"))
    rank = numbered(sizes, F.col("size"), F.desc("community"), name="rank").select("community", "rank")
    return assembled(local, rank)


def greedy_window(g: Graph, window: int = 5) -> DataFrame:
    """Component by component (the largest first), by window_greedy; vertices without edges last."""
    from loomgraph.operators.kernels import components

    label = cut(components(g).withColumnRenamed("component", "community"))
    local = grouped(g, label, window_greedy(window))
    sizes = label.groupBy("community").agg(F.count("*").alias("size"))
    rank = numbered(sizes, F.desc("size"), F.col("community"), name="rank").select("community", "rank")
    lone = degrees(g).where("out_degree + in_degree = 0").select("id")
    return assembled(local, rank, lone)


by_value(__name__)
