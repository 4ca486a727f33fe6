"""The graph kernels. Each loop round is one plan over the edges; its result is cut
into the checkpoint folder, so plans stay short and lost executors cost one round."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.construct import degrees
from loomgraph.runtime import by_value, laid_out, partitions, release
from loomgraph.runtime import cut_flat as cut

DAMPING = 0.85
#: Rounds that share a plan before it is cut.
EVERY = 4
#: Triangles: out-edges of a range, tasks that share one, vertices whose degrees are sent to all tasks.
BLOCK, SUBS, SENT = 4_000_000, 3, 2_000_000
#: Cells of a task's table of marks, and lookups between two of its uses.
CELLS, WORK = 16_000_000, 2_000_000


def _shares(g: Graph) -> DataFrame:
    """Edges with 1 / out-degree of their source, laid out by it: rounds move ranks only."""
    out = g.edges.groupBy("src").agg((1.0 / F.count("*")).alias("share"))
    return laid_out(g.edges.select("src", "dst").join(out, "src"))


def pagerank(g: Graph, max_iters: int = 20, epsilon: float = 1e-4, fixed_work: bool = False, damping: float = DAMPING) -> tuple[DataFrame, dict]:
    """Jacobi PageRank: (id, score) and {iterations, error, converged}.

    A vertex without out-edges contributes nothing (its mass is dropped). Stops when the
    L1 change falls below epsilon, unless fixed_work. Each round is one join and one
    aggregation; vertices without in-edges come in as rows of nought.
    """
    n = g.vertices.count()
    ids, shares = cut(g.vertices.select("id")), _shares(g)
    base = (1.0 - damping) / max(1, n)
    rank = ids.withColumn("score", F.lit(1.0 / max(1, n)))
    still = ids.select(F.col("id"), F.lit(0.0).alias("c"))
    error, done = None, 0
    for turn in range(1, max_iters + 1):
        sent = shares.join(rank.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("score") * F.col("share")).alias("c"))
        new = sent.unionAll(still).groupBy("id").agg((F.lit(base) + damping * F.sum("c")).alias("score"))
        done = turn
        if fixed_work:
            rank = cut(new) if turn % EVERY == 0 else new
            continue
        new = cut(new)
        error = new.join(rank.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
        rank = new
        if error < epsilon:
            break
    return rank, {"iterations": done, "error": error, "converged": error is not None and error < epsilon}


def pagerank_residual(g: Graph, rank: DataFrame, damping: float = DAMPING) -> float:
    """The verifier: L1 change of one more round."""
    n = g.vertices.count()
    sent = _shares(g).join(rank.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("score") * F.col("share")).alias("c"))
    new = sent.unionAll(g.vertices.select("id", F.lit(0.0).alias("c"))).groupBy("id").agg((F.lit((1 - damping) / max(1, n)) + damping * F.sum("c")).alias("new"))
    return new.join(rank, "id").agg(F.sum(F.abs(F.col("new") - F.col("score")))).first()[0] or 0.0


def checked_sources(g: Graph, sources: list[int]) -> list[int]:
    """Sources in original ids; repeats, unknown and isolated ones are refused."""
    if len(set(sources)) != len(sources):
        raise ValueError("a source is repeated")
    have = {r["src"] for r in g.edges.where(F.col("src").isin(sources)).select("src").distinct().collect()}
    if missing := [s for s in sources if s not in have]:
        raise ValueError(f"sources without out-edges: {missing}")
    return sources


def bfs(g: Graph, source: int) -> DataFrame:
    """(id, depth, parent) of the vertices reached; the parent is the least possible id, the
    source's its own. Only the frontier is joined; visited vertices are anti-joined."""
    seen = cut(g.vertices.where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("depth"), F.col("id").alias("parent")))
    front, depth = seen, 0
    while not front.isEmpty():
        depth += 1
        near = g.edges.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        front = cut(near.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).cast("long").alias("depth"), "parent"))
        seen = seen.unionByName(front)
        if depth % EVERY == 0:
            seen = cut(seen)
    return seen


def bfs_stats(g: Graph, tree: DataFrame) -> DataFrame:
    """(tree_nodes, tree_edges): vertices reached and the sum of their out-degrees."""
    return tree.select("id").join(degrees(g).select("id", "out_degree"), "id").agg(F.count("*").alias("tree_nodes"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("tree_edges"))


def components_sv(g: Graph) -> DataFrame:
    """(id, component), the least id of the weak component: hooking by the least label over
    the edges, then shortcuts through the label's own label, until nothing changes."""
    both = cut(g.edges.select("src", "dst").union(g.edges.select("dst", "src")).distinct())
    label = cut(g.vertices.select("id", F.col("id").alias("c")))
    while True:
        near = both.join(label, both["src"] == label["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
        hooked = label.join(near, "id", "left").select("id", "c", F.least("c", "m").alias("m"))
        # the root that a vertex hangs from takes the vertex's new label too
        roots = hooked.groupBy(F.col("c").alias("root")).agg(F.min("m").alias("r"))
        pulled = hooked.join(roots, F.col("c") == F.col("root")).select("id", F.least("m", "r").alias("c"))
        jump = pulled.select(F.col("id").alias("j"), F.col("c").alias("cj"))
        new = cut(pulled.join(jump, F.col("c") == F.col("j")).select("id", F.least("c", "cj").alias("c")))
        changed = new.join(label.withColumnRenamed("c", "old"), "id").where("c <> old")
        done = changed.isEmpty()
        label = new
        if done:
            return label.withColumnRenamed("c", "component")


def components(g: Graph) -> DataFrame:
    """(id, component) of all vertices, by stars; an isolated vertex is its own."""
    from loomgraph.operators.components import connected_components

    found = connected_components(g.edges)
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_stats(labels: DataFrame, k: int = 5) -> DataFrame:
    """(component, size) of the k largest; ties by the smaller label."""
    return labels.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(k)


def sssp(g: Graph, source: int) -> DataFrame:
    """(id, dist) of the vertices reached, over non-negative weights: the frontier holds
    those whose distance fell in the last round."""
    dist = cut(g.vertices.where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("dist")))
    front = dist
    while not front.isEmpty():
        reach = g.edges.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("new"))
        best = reach.groupBy("id").agg(F.min("new").alias("new"))
        old = dist.withColumnRenamed("dist", "old")
        merged = cut(best.join(old, "id", "full_outer").select("id", F.least("new", "old").alias("dist"), (F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))).alias("fell")))
        dist, front = merged.select("id", "dist"), merged.where("fell").select("id", "dist")
    return dist


def sssp_stats(dist: DataFrame) -> DataFrame:
    """(reachable, total, fingerprint): the fingerprint does not depend on the rows' order."""
    mark = F.bit_xor(F.xxhash64("id", "dist"))
    return dist.agg(F.count("*").alias("reachable"), F.coalesce(F.sum("dist"), F.lit(0)).alias("total"), F.coalesce(mark, F.lit(0)).alias("fingerprint"))


def betweenness(g: Graph, sources: list[int]) -> DataFrame:
    """(id, score): Brandes' dependencies from the sources, the source's own included, over the greatest.

    A forward round sums path counts level by level, a backward round the
    dependencies; with no paths at all scores are 0.
    """
    total = g.vertices.select("id", F.lit(0.0).alias("d")).limit(0)
    for s in sources:
        level = cut(g.vertices.where(F.col("id") == s).select("id", F.lit(1.0).alias("paths")))
        levels, seen = [level], level.select("id")
        while True:
            near = g.edges.join(level.withColumnRenamed("id", "src"), "src").join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti")
            level = cut(near.groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths")))
            if level.isEmpty():
                break
            levels.append(level)
            seen = seen.union(level.select("id"))
        below = levels[-1].withColumn("d", F.lit(0.0))
        parts = [below]
        for upper in reversed(levels[:-1]):
            down = below.select(F.col("id").alias("dst"), F.col("paths").alias("pv"), "d")
            up = g.edges.join(upper.select(F.col("id").alias("src"), F.col("paths").alias("pu")), "src").join(down, "dst")
            sums = up.groupBy(F.col("src").alias("id")).agg(F.sum(F.col("pu") / F.col("pv") * (1 + F.col("d"))).alias("d"))
            below = cut(upper.join(sums, "id", "left").select("id", "paths", F.coalesce("d", F.lit(0.0)).alias("d")))
            parts.append(below)
        for p in parts:
            total = total.union(p.select("id", "d"))
    sums = cut(total.union(g.vertices.select("id", F.lit(0.0))).groupBy("id").agg(F.sum("d").alias("d")))
    most = sums.agg(F.max("d")).first()[0]
    return sums.select("id", (F.col("d") / F.lit(most if most else 1.0)).alias("score"))


def _out_lists(g: Graph) -> DataFrame:
    """(src, out): each undirected edge once, from the end of the lower (degree, id), as lists."""
    half = cut(g.edges.where("src < dst").select("src", "dst"))
    d = cut(half.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d")))
    held = F.broadcast(d) if d.count() <= SENT else d
    e = half.join(held.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(held.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    e = e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"))
    out = cut(e.groupBy("src").agg(F.collect_list("dst").alias("out")))
    release(half, d)
    return out


class _Block:
    """The lists of a range of vertices, to be met by lists of others."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        order = np.argsort(ids)
        starts = np.cumsum(sizes) - sizes
        self.ids, self.starts, self.sizes = ids[order], starts[order], sizes[order]
        self.ends, at = np.unique(flat, return_inverse=True)
        self.at = at.astype(np.int32)

    def met(self, src: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        """Yields (u, x, y) of the triangles in which u's list holds x and y and x's list, of this block, holds y."""
        if not self.ids.size or not self.ends.size or not flat.size:
            return
        row = np.repeat(np.arange(sizes.size), sizes)
        i = np.minimum(np.searchsorted(self.ids, flat), self.ids.size - 1)
        j = np.minimum(np.searchsorted(self.ends, flat), self.ends.size - 1)
        here, there = self.ids[i] == flat, self.ends[j] == flat
        row_x, x, row_y, y = row[here], i[here], row[there], j[there]
        work = np.cumsum(np.bincount(row_x, self.sizes[x], sizes.size))
        step, low = max(1, CELLS // self.ends.size), 0
        mark = np.zeros(min(step, sizes.size) * self.ends.size, bool)
        while low < sizes.size:
            # some rows: as many as have cells, and not much more than WORK to look at
            done = work[low - 1] if low else 0
            high = min(low + step, sizes.size, max(low + 1, int(np.searchsorted(work, done + WORK, "right"))))
            a, b = np.searchsorted(row_x, (low, high))
            c, d = np.searchsorted(row_y, (low, high))
            cells = (row_y[c:d] - low) * self.ends.size + y[c:d]
            mark[cells] = True
            for s in range(a, b, CELLS // 64):
                xs = x[s : min(b, s + CELLS // 64)]
                n = self.sizes[xs]
                first = np.repeat(np.arange(xs.size), n)
                z = self.at[np.repeat(self.starts[xs] - (np.cumsum(n) - n), n) + np.arange(first.size)]
                hit = np.flatnonzero(mark[(row_x[s : s + xs.size] - low)[first] * self.ends.size + z])
                yield src[row_x[s : s + xs.size][first[hit]]], self.ids[xs[first[hit]]], self.ends[z[hit]]
            mark[cells] = False
            low = high


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = batch.column("out")
    flat = out.flatten().to_numpy(zero_copy_only=False)
    return batch.column("src").to_numpy(), out.value_lengths().to_numpy().astype(np.int64), flat


def _counted(g: Graph, p_n: int, p_m: int, block: int) -> DataFrame:
    """(tile, triangles), the tiles that have any.

    No wedge is shuffled. Vertices are cut into ranges of about `block` out-edges; a vertex's list
    goes once to each range that holds one of its members, and meets the range's lists there.
    A turn takes some ranges and then deletes what it wrote, so that the disk holds a few copies of the edges at most.
    """
    spark = g.edges.sparkSession
    lists = _out_lists(g)
    m = lists.agg(F.sum(F.size("out"))).first()[0] or 0
    n = max(1, -(-m // block))
    cuts = lists.select("src", F.explode("out")).agg(F.percentile_approx("src", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    bounds = np.array(cuts, np.int64)  # range r holds what is over r of them
    a_turn = max(4, spark.sparkContext.defaultParallelism // SUBS)
    found = []
    for low in range(0, n, a_turn):

        def deal(batches, low=low):
            for batch in batches:
                src, sizes, flat = _lists(batch)
                r = np.searchsorted(bounds, src)
                own = np.repeat(np.flatnonzero((r >= low) & (r < low + a_turn)), SUBS)
                to = np.searchsorted(bounds, flat)
                row = np.repeat(np.arange(sizes.size), sizes)
                on = (to >= low) & (to < low + a_turn)
                both = np.unique(row[on] * np.int64(a_turn) + (to[on] - low))
                at = both // a_turn
                take = pa.array(np.concatenate([own, at]))
                part = np.concatenate([r[own] * SUBS + np.tile(np.arange(SUBS), own.size // SUBS), (low + both % a_turn) * SUBS + src[at] % SUBS])
                kind = np.repeat(np.array([0, 1], np.int32), [own.size, at.size])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind), batch.column("src").take(take), batch.column("out").take(take)], names=["part", "kind", "src", "out"])

        def count(batches):
            now, held, block_ = None, [], None
            tiles = np.zeros(p_n * p_m, np.int64)
            for batch in batches:
                part, kind = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
                edges = np.flatnonzero(np.diff(part * 2 + kind)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
                    if a == b:
                        continue
                    if part[a] != now:
                        now, held, block_ = part[a], [], None
                    piece = _lists(batch.slice(a, b - a))
                    if kind[a] == 0:
                        held.append(tuple(x.copy() for x in piece))
                        continue
                    if block_ is None:
                        block_ = _Block(*(np.concatenate(x) for x in zip(*held))) if held else _Block(*(np.zeros(0, np.int64),) * 3)
                        held = []
                    for u, x, y in block_.met(*piece):
                        tiles += np.bincount(u % p_n * p_m + np.minimum(x, y) % p_m, minlength=p_n * p_m)
            at = np.flatnonzero(tiles)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(tiles[at], pa.int64())], names=["tile", "triangles"])

        dealt = lists.mapInArrow(deal, "part long, kind int, src long, out array<long>")
        laid = dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "kind")
        found.append(cut(laid.mapInArrow(count, "tile long, triangles long")))
        release(None if low + a_turn < n else lists)
    return reduce(DataFrame.unionByName, found).groupBy("tile").agg(F.sum("triangles").alias("triangles"))


def triangles(g: Graph, block: int = BLOCK) -> DataFrame:
    """(total): each triangle once. Edges point from the lower (degree, id), so no vertex has many out-edges."""
    return _counted(g, 1, 1, block).agg(F.coalesce(F.sum("triangles"), F.lit(0)).alias("total"))


def triangles_by_tile(g: Graph, p_n: int, p_m: int, block: int = BLOCK) -> DataFrame:
    """(tile, triangles): by the tile of the edge from the lowest end; the tiles' sum is the total."""
    return _counted(g, p_n, p_m, block)


def bfs_traffic(g: Graph, source: int, owners: DataFrame) -> DataFrame:
    """(depth, frontier, remote): a partitioned BFS's frontier sizes, and the frontier edges that
    cross from one owner (id, owner) to another, per superstep."""
    tree = bfs(g, source)
    o = owners.select(F.col("id").alias("src"), F.col("owner").alias("os"))
    p = owners.select(F.col("id").alias("dst"), F.col("owner").alias("od"))
    crossing = g.edges.join(tree.select(F.col("id").alias("src"), "depth"), "src").join(o, "src").join(p, "dst").where("os <> od")
    remote = crossing.groupBy("depth").agg(F.count("*").alias("remote"))
    return tree.groupBy("depth").agg(F.count("*").alias("frontier")).join(remote, "depth", "left").select("depth", "frontier", F.coalesce("remote", F.lit(0)).alias("remote"))


def octile_sources(g: Graph, seed: int = 0) -> DataFrame:
    """(octile, id): one source from each eighth of the largest component's vertices ranked by
    (out-degree, id); the place within an eighth is the seed's."""
    from loomgraph.graph import numbered

    labels = components(g)
    top = component_stats(labels, 1).select("component")
    inside = labels.join(F.broadcast(top), "component", "left_semi").join(degrees(g).select("id", "out_degree"), "id")
    ranked = numbered(inside, F.col("out_degree"), F.col("id"), name="r")
    n = F.lit(ranked.count())
    octile = F.floor(F.col("r") * 8 / n)
    within = ranked.withColumn("octile", octile).withColumn("lo", F.ceil(F.col("octile") * n / 8)).withColumn("hi", F.ceil((F.col("octile") + 1) * n / 8))
    return within.where((F.col("r") - F.col("lo")) == F.pmod(F.lit(seed), F.col("hi") - F.col("lo"))).select("octile", "id")


by_value(__name__)
