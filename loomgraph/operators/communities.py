"""Community detection in bulk-synchronous rounds, and community statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, numbered
from loomgraph.operators.construct import degrees
from loomgraph.runtime import by_value, partitions
from loomgraph.runtime import cut_flat as cut

ROUNDS, PASSES, SHRINK = 10, 10, 0.8


def sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("community").agg(F.count("*").alias("size"))


def total_degrees(g: Graph, membership: DataFrame) -> DataFrame:
    d = degrees(g).select("id", "out_degree")
    return membership.join(d, "id").groupBy("community").agg(F.sum("out_degree").alias("total_degree"))


def disconnected(g: Graph, membership: DataFrame) -> DataFrame:
    """(community, parts) of the communities whose inner edges leave more than one component."""
    from loomgraph.operators.components import connected_components

    a = membership.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    inner = g.edges.join(a, "src").join(b, "dst").where("ca = cb")
    label = connected_components(inner)
    all_ = membership.join(label, "id", "left").select("community", F.coalesce("component", "id").alias("component"))
    return all_.groupBy("community").agg(F.count_distinct("component").alias("parts")).where("parts > 1")


def modularity(g: Graph, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity), the standard one: sum over communities of inside/2M - r (total/2M)^2,
    with 2M the weight of all directed rows."""
    a = membership.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = g.edges.join(a, "src").join(b, "dst")
    per = e.groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("total"))
    whole = per.agg(F.sum("inside").alias("i"), F.sum("total").alias("w"), F.sum(F.col("total").cast("double") * F.col("total")).alias("t2"))
    return whole.select(F.coalesce(F.col("i") / F.col("w") - F.lit(resolution) * F.col("t2") / (F.col("w").cast("double") * F.col("w")), F.lit(0.0)).alias("modularity"))


def adjacent_modularity(g: Graph, membership: DataFrame) -> DataFrame:
    """(modularity) with the null term over adjacent pairs of one community only: a locality
    score, not the standard measure."""
    d = degrees(g).select("id", F.col("out_degree").cast("double").alias("k"))
    a = membership.join(d, "id").select(F.col("id").alias("src"), F.col("community").alias("ca"), F.col("k").alias("ka"))
    b = membership.join(d, "id").select(F.col("id").alias("dst"), F.col("community").alias("cb"), F.col("k").alias("kb"))
    e = g.edges.join(a, "src").join(b, "dst")
    m = F.lit(float(max(1, g.edges.count())))
    inner = F.when(F.col("ca") == F.col("cb"), 1 - F.col("ka") * F.col("kb") / m).otherwise(0.0)
    return e.agg(F.coalesce(F.sum(inner) / m, F.lit(0.0)).alias("modularity"))


def auto_resolution(g: Graph) -> float:
    """clip(0.5 + 0.25 log10(mean degree + 1), 0.5, 1.2), lowered for uneven degrees."""
    row = degrees(g).agg(F.avg("out_degree").alias("a"), F.stddev_pop("out_degree").alias("s")).first()
    mean = row["a"] or 0.0
    out = min(1.2, max(0.5, 0.5 + 0.25 * math.log10(mean + 1)))
    cv = (row["s"] or 0.0) / mean if mean else 0.0
    return max(0.5, out * 2 / max(2.0, math.sqrt(cv))) if cv > 2 else out


def label_propagation(g: Graph, rounds: int = 20, tolerance: float = 0.05, start: DataFrame | None = None, affected: DataFrame | None = None) -> DataFrame:
    """(id, community): each round a vertex takes the label of the greatest weight among its
    neighbours; ties go to the label of the greatest hash, so that no label wins everywhere. One half of the
    vertices moves, then the other, and halves are drawn anew for each round, which keeps pairs from
    swapping for ever. It ends when a round moves no more than `tolerance` of the vertices. start: labels to begin from; affected
    (id): only these may move, and then the neighbours of what moved.
    """
    label = cut((start if start is not None else g.vertices.select("id", F.col("id").alias("community"))).select("id", "community"))
    n = max(1, label.count())
    may = cut(affected.select("id").distinct()) if affected is not None else None
    changed = 0
    for turn_no in range(2 * rounds):
        rows = g.edges.join(label.withColumnRenamed("id", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = rows.groupBy("src").agg(F.max(F.struct("w", F.xxhash64("community").alias("h"), F.col("community").alias("c"))).alias("b")).select(F.col("src").alias("id"), F.col("b.c").alias("new"))
        turn = F.pmod(F.xxhash64("id", F.lit(turn_no // 2)), F.lit(2)) == turn_no % 2
        if may is not None:
            best = best.join(may, "id", "left_semi")
        joined = cut(label.join(best.where(turn), "id", "left").select("id", "community", F.coalesce("new", "community").alias("new")))
        moved = joined.where("community <> new").select("id")
        changed = moved.count() + (changed if turn_no % 2 else 0)
        label = joined.select("id", F.col("new").alias("community"))
        if may is not None:
            may = cut(may.union(g.edges.join(moved.withColumnRenamed("id", "src"), "src").select("dst")).distinct())
        if turn_no % 2 and changed <= tolerance * n:
            break
    return label


def affected_by(g: Graph, membership: DataFrame, deletions: DataFrame, insertions: DataFrame) -> DataFrame:
    """Delta screening: (id) of the ends of deletions inside a community and of insertions
    between two, their neighbours, and all of the communities they touch."""
    a = membership.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    lost = deletions.select("src", "dst").join(a, "src").join(b, "dst").where("ca = cb")
    new = insertions.select("src", "dst").join(a, "src", "left").join(b, "dst", "left").where("ca is null or cb is null or ca <> cb")
    ends = lost.unionByName(new)
    ids = ends.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    near = g.edges.join(ids.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"))
    touched = ends.select(F.explode(F.array("ca", "cb")).alias("community")).where("community is not null").distinct()
    whole = membership.join(touched, "community", "left_semi").select("id")
    return ids.union(near).union(whole).distinct()


def _gains(edges: DataFrame, label: DataFrame, strength: DataFrame, total2m: float, resolution: float) -> DataFrame:
    """(id, own, best, gain): the neighbouring community of the greatest gain in modularity."""
    totals = label.join(strength, "id").groupBy("community").agg(F.sum("s").alias("tot"))
    e = edges.where("src <> dst").join(label.select(F.col("id").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
    own = label.join(strength, "id").select(F.col("id").alias("src"), F.col("community").alias("own"), "s")
    inside = e.select("src", F.col("community").alias("own"), F.col("w").alias("win"))
    base = own.join(inside, ["src", "own"], "left").join(totals.select(F.col("community").alias("own"), F.col("tot").alias("town")), "own")
    there = e.join(totals, "community").join(base, "src").where("community <> own")
    gain = (F.col("w") - F.coalesce("win", F.lit(0.0))) - resolution * F.col("s") * (F.col("tot") - (F.col("town") - F.col("s"))) / total2m
    best = there.select("src", "own", F.struct(gain.alias("gain"), (-F.col("community")).alias("c")).alias("b")).groupBy("src", "own").agg(F.max("b").alias("b"))
    return best.select(F.col("src").alias("id"), "own", (-F.col("b.c")).alias("best"), F.col("b.gain").alias("gain")).where("gain > 1e-12")


def _quality(edges: DataFrame, label: DataFrame, total2m: float, resolution: float) -> float:
    g = Graph(label.select("id"), edges)
    _ = total2m
    return modularity(g, label, resolution).first()[0]


def _local_moves(edges: DataFrame, ids: DataFrame, resolution: float, rounds: int, bound: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Synchronous local moving. A round's moves go from the greater to the smaller community
    id or the reverse, in turn, so that two never swap; a round that lowers the
    modularity is dropped. bound: moves stay inside these communities (refinement)."""
    if bound is not None:
        a, b = bound.select(F.col("id").alias("src"), F.col("community").alias("ba")), bound.select(F.col("id").alias("dst"), F.col("community").alias("bb"))
        inner = cut(edges.join(a, "src").join(b, "dst").where("ba = bb").select("src", "dst", "weight"))
    else:
        inner = edges
    total2m = float(edges.agg(F.sum("weight")).first()[0] or 0.0)
    label = cut(ids.select("id", F.col("id").alias("community")))
    if not total2m:
        return label, 0
    strength = cut(edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").cast("double").alias("s")))
    now, moved, idle = _quality(edges, label, total2m, resolution), 0, 0
    for turn in range(2 * rounds):
        gains = _gains(inner, label, strength, total2m, resolution)
        way = F.col("best") < F.col("own") if turn % 2 == 0 else F.col("best") > F.col("own")
        # in a community that others leave, staying put keeps the target's members in place
        moves = cut(gains.where(way).select("id", "best"))
        new = cut(label.join(moves, "id", "left").select("id", F.coalesce("best", "community").alias("community")))
        value = _quality(edges, new, total2m, resolution)
        if value > now + 1e-7:
            label, now, moved, idle = new, value, moved + 1, 0
        else:
            idle += 1
            if idle == 2:
                break
    return label, moved


def louvain(g: Graph, resolution: float | None = None, passes: int = PASSES, rounds: int = ROUNDS, refine: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """(id, community) and the hierarchy's levels, finest first. refine: Leiden's step, by which
    the next graph's vertices are well-connected parts of the communities, and
    the communities themselves are where their moving starts from.

    Each pass aggregates the graph by community and goes on with it; it ends when
    nothing moves or communities shrink by less than a fifth.
    """
    gamma = auto_resolution(g) if resolution is None else resolution
    edges, ids = cut(g.edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))), g.vertices.select("id")
    member = cut(ids.select("id", F.col("id").alias("node")))
    levels: list[DataFrame] = []
    for _ in range(passes):
        label, moved = _local_moves(edges, ids, gamma, rounds)
        if refine and moved:
            label, _ = _local_moves(edges, ids, gamma, 1, bound=label)
        before, after = ids.count(), label.select("community").distinct().count()
        member = cut(member.join(label.select(F.col("id").alias("node"), "community"), "node").select("id", F.col("community").alias("node")))
        levels.append(member.select("id", F.col("node").alias("community")))
        if not moved or after >= before * SHRINK or after <= 1:
            break
        a, b = label.select(F.col("id").alias("src"), F.col("community").alias("ca")), label.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
        edges = cut(edges.join(a, "src").join(b, "dst").groupBy(F.col("ca").alias("src"), F.col("cb").alias("dst")).agg(F.sum("weight").alias("weight")))
        ids = cut(label.select(F.col("community").alias("id")).distinct())
    if refine:  # the last level's communities, each vertex with the parts that move together
        label, moved = _local_moves(edges, ids, gamma, rounds)
        if moved:
            member = cut(member.join(label.select(F.col("id").alias("node"), "community"), "node").select("id", F.col("community").alias("node")))
            levels.append(member.select("id", F.col("node").alias("community")))
    return levels[-1], levels


def leiden(g: Graph, resolution: float | None = None, passes: int = PASSES, rounds: int = ROUNDS) -> DataFrame:
    return louvain(g, resolution, passes, rounds, refine=True)[0]


def super_graph(g: Graph, membership: DataFrame) -> DataFrame:
    """(src, dst, weight) between communities, src <= dst, each undirected weight once."""
    a = membership.select(F.col("id").alias("src"), F.col("community").alias("ca"))
    b = membership.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
    e = g.edges.join(a, "src").join(b, "dst")
    low, high = F.least("ca", "cb"), F.greatest("ca", "cb")
    w = F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight") / 2.0).otherwise(F.col("weight") / 2.0))
    return e.groupBy(low.alias("src"), high.alias("dst")).agg(w.alias("weight"))


def merged_small(g: Graph, membership: DataFrame, least: int) -> DataFrame:
    """Communities of fewer than `least` vertices join the neighbour they share most weight with
    (ties: the smaller id); of two that would join each other, the greater id moves."""
    size = sizes(membership)
    s = super_graph(g, membership).where("src <> dst")
    both = s.union(s.select("dst", "src", "weight"))
    small = size.where(F.col("size") < least).select(F.col("community").alias("src"))
    best = both.join(small, "src").groupBy("src").agg(F.max(F.struct("weight", (-F.col("dst")).alias("d"))).alias("b")).select("src", (-F.col("b.d")).alias("to"))
    back = best.select(F.col("src").alias("to"), F.col("to").alias("src"))
    mutual = best.join(back, ["src", "to"], "left_semi").where("src < to")
    moves = best.join(mutual.select("src"), "src", "left_anti")
    # follow chains of small communities to where they end
    while True:
        hop = moves.select(F.col("src").alias("to"), F.col("to").alias("then"))
        new = cut(moves.join(hop, "to", "left").select("src", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("went")))
        moves = new.select("src", "to")
        if new.where("went").isEmpty():
            break
    return membership.join(moves.withColumnRenamed("src", "community"), "community", "left").select("id", F.coalesce("to", "community").alias("community"))


def least_size(n: int, communities: int) -> int:
    """The least size below which communities are merged: max(50, min(average / 4, sqrt n)), 2000 at most."""
    return int(min(2000, max(50, min(n / max(1, communities) / 4, math.sqrt(n)))))


def _merged(ids: np.ndarray, sizes: np.ndarray, dst: np.ndarray, weight: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, its merges' root) in the tree's depth-first order, as places in ids (ascending), of one component.

    dst, weight: the neighbours of each of ids in turn, sizes of them. What a vertex has around it is summed up by
    root when its turn comes, and goes to the one it joins; its own lists are let go then.
    """
    n = ids.size
    at = np.concatenate([[0], np.cumsum(sizes)])
    near = [[(dst[i:j], weight[i:j])] for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    strength = np.bincount(np.repeat(np.arange(n), sizes), weight, n)
    root, joined = np.arange(n), np.zeros(n, bool)
    children: dict[int, list[int]] = {}
    for u in np.lexsort((ids, sizes)).tolist():
        to, w = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*near[u]))
        near[u] = []
        r = root[to]
        while (r != (up := root[r])).any():
            r = up
        root[to] = r
        others = r != u
        around, back = np.unique(r[others], return_inverse=True)
        if not around.size:
            continue
        w = np.bincount(back, w[others], around.size)
        gain = w - strength[u] * strength[around] / whole
        k = int(np.argmax(gain))  # the first of the greatest: the smallest id
        if gain[k] > 0:
            v = int(around[k])
            root[u], joined[u] = v, True
            children.setdefault(v, []).append(u)
            strength[v] += strength[u]
            rest = around != v
            if near[v] and rest.any():
                near[v].append((around[rest].astype(np.int32), w[rest]))
    out, top = [], []
    for r in np.flatnonzero(~joined).tolist():
        stack = [r]
        while stack:
            v = stack.pop()
            out.append(v)
            top.append(r)
            stack += children.get(v, [])
    return np.array(out), np.array(top)


def incremental_aggregation(g: Graph, limit: int = 200_000, edges: int = 16_000_000) -> DataFrame:
    """(id, community, place): Rabbit-style merging of each vertex, degrees ascending, into the
    neighbour of the greatest gain w - s_u s_v / W (ties: the smaller id), and the depth-first
    place in the tree of merges. One task a component, at some 30 bytes a directed edge; components of more than `limit`
    vertices or `edges` directed edges are merged in distributed rounds instead (louvain at resolution 1), each
    vertex placed by the communities it goes through, the largest first.
    """
    from loomgraph.operators.kernels import components

    label = cut(components(g))
    out = g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("m"))
    size = label.join(out, "id", "left").groupBy("component").agg(F.count("*").alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("m"))
    marked = cut(label.join(size, "component").select("id", "component", (F.expr(f"n > {limit} or m > {edges}")).alias("big")))
    fit = marked.where("not big").select(F.col("id").alias("src"), "component")
    rows = g.edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("weight")).join(fit, "src").select("component", "src", "dst", "weight")
    alone = fit.select("component", "src", F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("weight"))
    whole = float(g.edges.agg(F.sum("weight")).first()[0] or 1.0)

    def merge(src: list, dst: list, weight: list) -> pa.RecordBatch:
        """Of one component's rows by src, a row without dst at the head of each vertex's."""
        to, empty = pa.chunked_array(dst), pa.chunked_array(dst).is_null().to_numpy()
        ids, sizes = np.unique(pa.chunked_array(src).to_numpy(), return_counts=True)
        local = np.searchsorted(ids, to.drop_null().to_numpy()).astype(np.int32)
        v, r = _merged(ids, sizes - 1, local, pa.chunked_array(weight).to_numpy()[~empty], whole)
        return pa.RecordBatch.from_arrays([pa.array(ids[v]), pa.array(ids[r]), pa.array(np.arange(v.size))], names=["id", "community", "place"])

    def run(batches):
        now, held = None, ([], [], [])
        for batch in batches:
            component = batch.column(0).to_numpy()
            edge = (np.flatnonzero(np.diff(component)) + 1).tolist()
            for i, j in zip([0, *edge], [*edge, component.size]):
                if i == j:
                    continue
                if held[0] and component[i] != now:
                    yield merge(*held)
                    held = ([], [], [])
                now = component[i]
                for have, c in zip(held, batch.columns[1:]):
                    have.append(c.slice(i, j - i))
        if held[0]:
            yield merge(*held)

    laid = rows.unionByName(alone).repartition(partitions(g.edges.sparkSession), "component").sortWithinPartitions("component", "src")
    small = laid.mapInArrow(run, "id long, community long, place long")
    large = marked.where("big")
    if large.isEmpty():
        return small
    big = Graph(large.select("id"), g.edges.join(large.select(F.col("id").alias("src")), "src", "left_semi"))
    found, levels = louvain(big, 1.0)
    placed, path = found, []
    for k, level in enumerate(levels[:-1]):
        placed = placed.join(level.select("id", F.col("community").alias(f"l{k}")), "id")
        path.insert(0, F.col(f"l{k}"))
    placed = numbered(placed, F.col("community"), *path, F.col("id"), name="place")
    return small.union(placed.select("id", "community", "place"))


def rabbit(g: Graph) -> DataFrame:
    """(old_id, new_id): communities of the merges, the largest first, each in its tree's order; isolated vertices last."""
    m = cut(incremental_aggregation(g))
    lone = degrees(g).where("out_degree + in_degree = 0").select("id", F.lit(1).alias("lone"))
    ranked = m.join(sizes(m), "community").join(lone, "id", "left")
    order = numbered(ranked, F.coalesce("lone", F.lit(0)), F.desc("size"), F.col("community"), F.col("place"), F.col("id"))
    return order.select(F.col("id").alias("old_id"), "new_id")


def community_ranks(membership: DataFrame, g: Graph, by: str = "size_desc") -> DataFrame:
    """(community, rank) by size, total degree or id."""
    rows = sizes(membership).join(total_degrees(g, membership), "community", "left")
    rows = rows.withColumn("total_degree", F.coalesce("total_degree", F.lit(0)))
    kinds = {
        "size_desc": [F.desc("size")], "size_asc": [F.asc("size")], "degree_desc": [F.desc("total_degree")],
        "degree_asc": [F.asc("total_degree")], "identity": [],
    }
    return numbered(rows, *kinds[by], F.col("community"), name="rank").select("community", "rank")


by_value(__name__)
