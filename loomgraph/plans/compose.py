"""Composed orderings: detect communities, order them, order within them, refine, assemble.

A plan is written as tokens, `leiden:compose:comm_size_desc:intra_bfs`; the last token
of an axis holds. What a plan lacks or contradicts is refused when it is parsed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph, numbered
from loomgraph.operators import communities as C
from loomgraph.operators import orderings as O
from loomgraph.operators.construct import degrees
from loomgraph.operators.orderings import cuthill_mckee, hub_first_search
from loomgraph.runtime import by_value, cut

DETECTORS = {
    "leiden": "leiden", "cd_leiden": "leiden", "rabbit": "rabbit", "cd_rabbit": "rabbit", "cd_lp": "lp", "fast": "lp",
    "cd_louvain": "louvain", "norefine": "louvain", "cd_gve": "leiden", "cd_hybrid": "leiden", "hubcluster": "hubcluster",
}
STRATEGIES = {
    "compose", "layer", "community", "dbg", "dbg-global", "corder", "corder-global", "hubcluster", "hierarchical", "bfs", "dfs", "conn",
    "hcache", "hrab", "hlr", "tqr",
}
COMMUNITY = {
    "comm_size": "size-desc", "comm_size_desc": "size-desc", "comm_size_asc": "size-asc", "comm_degree": "degree-desc",
    "comm_degree_desc": "degree-desc", "comm_degree_asc": "degree-asc", "comm_identity": "identity", "comm_cut_min": "cut-min",
    "comm_capacity_runs": "capacity-runs",
}
INTRA = {
    "intra_bfs": "bfs", "intra_rcm": "rcm", "intra_rcmpp": "rcmpp", "intra_dendrogram": "dendrogram", "intra_gorder": "gorder",
    "intra_gorder_faithful": "gorder-faithful", "intra_hubsort": "hubsort", "intra_deg_asc": "deg-asc", "intra_hub2": "hub2",
    "intra_alternate": "alternate", "intra_random": "random", "intra_bndlast": "bndlast", "intra_core": "core",
}
SUPER = {"sg_none": "none", "sg_super_rabbit": "super-rabbit", "sg_super_rcm": "super-rcm", "sg_tile_rabbit": "tile-rabbit", "sg_hilbert": "hilbert"}
#: Communities up to which a plan over their pairs is made on the driver.
PAIRS = 4096
FALLBACK = 5000


@dataclass(frozen=True)
class Plan:
    detector: str = "leiden"
    ordering: str = "layer"
    super_order: str = "none"
    community_order: str = "size-desc"
    intra_order: str = "bfs"
    window: int = 5
    fallback: int = FALLBACK
    refine: bool = True
    swaps: bool = False
    resolution: float | None = None
    rounds: int = C.ROUNDS
    passes: int = C.PASSES
    l2_kib: int = 0
    llc_kib: int = 0
    value_bytes: int = 0


def _folded(token: str) -> str:
    return token.replace("-", "_").lower()


def _number(token: str, head: str) -> int | None:
    """The whole number after `head`, None if the token has another head; refused if it is no number."""
    if not re.match(rf"{head}-?[^a-z_]", token):
        return None
    digits = token[len(head) :]
    if not re.fullmatch(r"[0-9]+", digits, re.ASCII) or not 0 < int(digits) < 1 << 31:
        raise ValueError(f"{token}: not a positive number")
    return int(digits)


def parse(tokens: list[str] | str) -> Plan:
    """The plan of a token list. Numbers: the first with a point, or `res`, is the resolution;
    whole ones are rounds, then passes."""
    tokens = tokens.split(":") if isinstance(tokens, str) else list(tokens)
    plan, whole = Plan(), []
    compact = {k.replace("_", ""): v for d in (COMMUNITY, INTRA, SUPER) for k, v in d.items()}
    axis = {**dict.fromkeys(COMMUNITY.values(), "community_order"), **dict.fromkeys(INTRA.values(), "intra_order"), **dict.fromkeys(SUPER.values(), "super_order")}
    named = {**COMMUNITY, **INTRA, **SUPER, "cut_min": "cut-min", "cutmin": "cut-min"}
    for raw in tokens:
        t = _folded(raw)
        value = named.get(t) or compact.get(t.replace("_", ""))
        if value:
            plan = replace(plan, **{axis[value]: value})
        elif t == "norefine":
            plan = replace(plan, refine=False)
        elif t == "refine_2swap":
            plan = replace(plan, swaps=True)
        elif t in DETECTORS and t != "hubcluster":
            plan = replace(plan, detector=DETECTORS[t])
        elif raw.replace("_", "-") in STRATEGIES:
            plan = replace(plan, ordering=raw.replace("_", "-"))
        elif (n := _number(t, "capl2k")) is not None:
            plan = replace(plan, l2_kib=n)
        elif (n := _number(t, "capllck")) is not None:
            plan = replace(plan, llc_kib=n)
        elif (n := _number(t, "capv")) is not None:
            plan = replace(plan, value_bytes=n)
        elif (n := _number(t, "gordf")) is not None:
            plan = replace(plan, fallback=n)
        elif (n := _number(t, "gw")) is not None:
            plan = replace(plan, window=n)
        elif re.fullmatch(r"[0-9]+", t):
            whole.append(int(t))
        elif re.fullmatch(r"[0-9]*\.[0-9]+", t):
            plan = replace(plan, resolution=float(t))
        elif t in ("gvecsr", "totalm", "auto", "dynamic", "cd_parallel") or re.fullmatch(r"(sgmb|refine)[0-9]+", t):
            continue  # of the shared-memory engine: synchronous rounds have no counterpart
        else:
            raise ValueError(f"unknown token {raw!r}")
    if whole:
        plan = replace(plan, rounds=whole[0], passes=whole[1] if len(whole) > 1 else plan.passes)
    geometry = plan.l2_kib or plan.llc_kib or plan.value_bytes
    if plan.community_order == "capacity-runs":
        if plan.ordering != "compose" or not (plan.l2_kib and plan.llc_kib and plan.value_bytes) or plan.llc_kib < plan.l2_kib or plan.super_order != "none":
            raise ValueError("capacity runs need compose, both capacities and a value size, and no order of the super graph")
    elif geometry:
        raise ValueError("capacities without capacity runs")
    if plan.intra_order == "gorder-faithful" and plan.ordering != "compose":
        raise ValueError("this order within communities needs compose")
    return plan


def detect(g: Graph, plan: Plan) -> DataFrame:
    """(id, community[, place])."""
    if plan.detector == "rabbit":
        return C.incremental_aggregation(g)
    if plan.detector == "lp":
        return C.label_propagation(g)
    return C.louvain(g, plan.resolution, plan.passes, plan.rounds, refine=plan.refine and plan.detector == "leiden")[0]


def _nearest_chain(sizes: list[tuple[int, int]], weight: dict[tuple[int, int], float]) -> list[int]:
    """From the largest community, always the one that shares most weight with the last (ties:
    the larger, then the smaller id)."""
    size = dict(sizes)
    near: dict[int, dict[int, float]] = {}
    for (a, b), w in weight.items():
        if a != b:
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    left = sorted(size, key=lambda c: (-size[c], c))
    out, have = [], set()
    while left:
        c = left[0]
        while c is not None:
            out.append(c)
            have.add(c)
            c = min((x for x in near.get(c, {}) if x not in have), key=lambda x: (-near[c][x], -size[x], x), default=None)
        left = [x for x in left if x not in have]
    return out


def _capacity_runs(sizes: list[tuple[int, int]], weight: dict[tuple[int, int], float], plan: Plan) -> list[int]:
    """Whole communities in runs that fill L2, and runs of those that fill the LLC: a run starts with the
    largest left and goes on with what shares most weight with it and fits, else the largest that fits."""
    size = {c: n * plan.value_bytes for c, n in sizes}
    l2, llc = plan.l2_kib * 1024, plan.llc_kib * 1024
    rank = {c: i for i, (c, _) in enumerate(sorted(sizes, key=lambda x: (-x[1], x[0])))}
    near: dict[int, dict[int, float]] = {}
    for (a, b), w in weight.items():
        if a != b:
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    left, out = set(size), []
    while left:
        outer = 0
        while left and (outer == 0 or any(outer + size[c] <= llc for c in left)):
            seeds = [c for c in left if outer == 0 or outer + size[c] <= llc]
            seed = min(seeds, key=lambda c: (rank[c], c))
            run, inner = [seed], size[seed]
            left.discard(seed)
            while True:
                fits = [c for c in left if inner + size[c] <= l2 and outer + inner + size[c] <= llc]
                if not fits:
                    break
                score = {c: sum(near.get(c, {}).get(r, 0.0) for r in run) for c in fits}
                pick = min(fits, key=lambda c: (-score[c], rank[c], c))
                run.append(pick)
                inner += size[pick]
                left.discard(pick)
            out += run
            outer += inner
    return out


def order_communities(g: Graph, member: DataFrame, plan: Plan) -> DataFrame:
    """(community, rank)."""
    kind = plan.community_order
    count = C.sizes(member).count()
    if plan.super_order in ("super-rcm", "super-rabbit", "tile-rabbit") and count <= O.GREEDY:
        s = C.super_graph(g, member).where("src <> dst")
        sg = Graph.from_edges(s.withColumn("weight", F.ceil("weight")), False, C.sizes(member).select(F.col("community").alias("id"))).cut()
        order = O.reverse_cuthill_mckee(sg) if plan.super_order == "super-rcm" else C.rabbit(sg)
        return order.select(F.col("old_id").alias("community"), F.col("new_id").alias("rank"))
    if plan.super_order == "hilbert":
        from loomgraph.functions.scalar import hilbert

        at = numbered(C.sizes(member), F.desc("size"), F.col("community"), name="r").withColumns({"x": F.col("r") % 256, "y": F.floor(F.col("r") / 256)})
        return numbered(at.withColumn("h", hilbert("x", "y", 16)), F.col("h"), F.col("community"), name="rank").select("community", "rank")
    if kind in ("cut-min", "capacity-runs"):
        if count > PAIRS:
            kind = "degree-desc"
        else:
            sizes = [(r["community"], r["size"]) for r in C.sizes(member).collect()]
            weight = {(r["src"], r["dst"]): r["weight"] for r in C.super_graph(g, member).collect()}
            chain = _nearest_chain(sizes, weight) if kind == "cut-min" else _capacity_runs(sizes, weight, plan)
            return g.vertices.sparkSession.createDataFrame([(c, i) for i, c in enumerate(chain)] or [(0, 0)], "community long, rank long")
    return C.community_ranks(member, g, kind.replace("-", "_"))


def _core_numbers(ids: list[int], near: dict[int, list[int]]) -> list[int]:
    """Vertices by core number, then degree, both descending, then id; cores by peeling the least degree."""
    import heapq

    degree = {v: len(near[v]) for v in ids}
    heap = [(d, v) for v, d in degree.items()]
    heapq.heapify(heap)
    core, now, left = {}, 0, dict(degree)
    while heap:
        d, v = heapq.heappop(heap)
        if v in core or d != left[v]:
            continue
        now = max(now, d)
        core[v] = now
        for w in near[v]:
            if w not in core:
                left[w] -= 1
                heapq.heappush(heap, (left[w], w))
    return sorted(ids, key=lambda v: (-core[v], -degree[v], v))


def _swapped(order: list[int], near: dict[int, list[int]], passes: int = 3) -> list[int]:
    """Swaps neighbours in the order while that shortens the sum of distances along edges."""
    place = {v: i for i, v in enumerate(order)}
    for _ in range(passes):
        done = True
        for i in range(len(order) - 1):
            a, b = order[i], order[i + 1]
            gain = 0
            for v, p, q in ((a, i, i + 1), (b, i + 1, i)):
                gain += sum(abs(p - place[w]) - abs(q - place[w]) for w in near[v] if w not in (a, b))
            if gain > 0:
                order[i], order[i + 1] = b, a
                place[a], place[b] = i + 1, i
                done = False
        if done:
            break
    return order


def _far_start(ids: list[int], near: dict[int, list[int]]) -> list[int]:
    """Reverse Cuthill-McKee from a start that ranks well by low degree and by depth from the vertex of
    least degree, improved by at most three searches."""
    if len(ids) <= 32:
        return cuthill_mckee(ids, near)

    def depths(root: int) -> dict[int, int]:
        have, queue, i = {root: 0}, [root], 0
        while i < len(queue):
            for w in near[queue[i]]:
                if w not in have:
                    have[w] = have[queue[i]] + 1
                    queue.append(w)
            i += 1
        return have

    seed = min(ids, key=lambda v: (len(near[v]), v))
    depth = depths(seed)
    by_degree = {v: i for i, v in enumerate(sorted(ids, key=lambda v: (len(near[v]), v)))}
    by_depth = {v: i for i, v in enumerate(sorted(ids, key=lambda v: (-depth.get(v, -1), v)))}
    start = min(ids, key=lambda v: (0.5 * by_degree[v] + 0.5 * by_depth[v], v))
    for _ in range(3):
        d = depths(start)
        far = max(d.values())
        other = min((v for v in d if d[v] == far), key=lambda v: (len(near[v]), v))
        if max(depths(other).values()) <= far:
            break
        start = other
    order, have, i = [start], {start}, 0
    rest = iter(sorted(ids, key=lambda v: (len(near[v]), v)))
    while len(order) < len(ids):
        while i < len(order):
            for w in sorted((w for w in near[order[i]] if w not in have), key=lambda w: (len(near[w]), w)):
                have.add(w)
                order.append(w)
            i += 1
        nxt = next((v for v in rest if v not in have), None)
        if nxt is not None:
            have.add(nxt)
            order.append(nxt)
    return order[::-1]


def order_within(g: Graph, member: DataFrame, plan: Plan) -> DataFrame:
    """(id, community, local)."""
    kind = plan.intra_order
    greedy: dict[str, Callable] = {
        "bfs": hub_first_search, "rcm": cuthill_mckee, "rcmpp": _far_start, "core": _core_numbers,
        "gorder": O.window_greedy(plan.window, False, plan.fallback), "gorder-faithful": O.window_greedy(plan.window, True, plan.fallback),
    }
    if kind == "dendrogram" and "place" not in member.columns:
        kind = "bfs"
    member = member if kind == "dendrogram" else member.select("id", "community")
    if kind in greedy or plan.swaps:
        pick = greedy.get(kind, hub_first_search)
        return O.grouped(g, member.select("id", "community"), (lambda i, n: _swapped(pick(i, n), n)) if plan.swaps else pick)
    rows = member.join(degrees(g).select("id", F.col("out_degree").alias("d")), "id")
    if kind == "hub2":
        d = degrees(g).select(F.col("id").alias("dst"), F.col("out_degree").alias("dn"))
        score = g.edges.join(d, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("dn").alias("s"))
        rows, key = rows.join(score, "id", "left").na.fill(0, ["s"]), [F.desc("s")]
    elif kind == "bndlast":
        a, b = member.select(F.col("id").alias("src"), F.col("community").alias("ca")), member.select(F.col("id").alias("dst"), F.col("community").alias("cb"))
        out = g.edges.join(a, "src").join(b, "dst").where("ca <> cb").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("x"))
        rows, key = rows.join(out, "id", "left").na.fill(0, ["x"]), [F.asc("x"), F.desc("d")]
    else:
        key = {"hubsort": [F.desc("d")], "alternate": [F.desc("d")], "deg-asc": [F.asc("d")], "random": [F.xxhash64(F.lit(0xDEADBEEF), "community", "id")], "dendrogram": [F.col("place") if kind == "dendrogram" else F.lit(0)]}[kind]
    placed = numbered(rows, F.col("community"), *key, F.col("id"), name="at")
    start = placed.groupBy("community").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    local = placed.join(start, "community").withColumn("local", F.col("at") - F.col("first"))
    if kind == "alternate":  # hub, leaf, next hub, next leaf ..
        high = F.floor((F.col("n") + 1) / 2)
        local = local.withColumn("local", F.when(F.col("local") < high, 2 * F.col("local")).otherwise(2 * (F.col("n") - 1 - F.col("local")) + 1))
    return local.select("id", "community", "local")


def ordering(g: Graph, spec: list[str] | str = "leiden:compose") -> DataFrame:
    """(old_id, new_id) of a plan; vertices without edges are last, by id."""
    plan = parse(spec)
    return arrange(g, cut(detect(g, plan)), plan)


def arrange(g: Graph, member: DataFrame, plan: Plan) -> DataFrame:
    d = degrees(g)
    lone = d.where("out_degree + in_degree = 0").select("id")
    live = cut(member.join(lone, "id", "left_anti"))
    deg = live.join(d.select("id", F.col("out_degree").alias("d")), "id")
    last = lone.select("id", F.lit(1).alias("last"))

    def placed(rows: DataFrame, *keys) -> DataFrame:
        all_ = d.select("id").join(rows, "id", "left").join(last, "id", "left")
        return numbered(all_, F.coalesce("last", F.lit(0)), *keys, F.col("id")).select(F.col("id").alias("old_id"), "new_id")

    average = O.average_degree(g)
    kind = plan.ordering
    if kind in ("community", "hierarchical"):
        return placed(deg, F.col("community"), F.desc("d"))
    if kind == "hubcluster":
        n = deg.count()
        cut_at = numbered(deg, F.desc("d"), F.col("id"), name="r").where(F.col("r") == n // 100).select("d").first() if n else None
        return placed(deg, F.desc(F.col("d") >= (cut_at[0] if cut_at else 0)), F.col("community"), F.desc("d"))
    if kind == "dbg":
        return placed(deg, F.col("community"), O.bucket(F.col("d"), average).desc())
    if kind == "dbg-global":
        return placed(deg, O.bucket(F.col("d"), average).desc(), F.col("community"))
    if kind == "corder":
        return placed(deg, F.col("community"), F.desc(F.col("d") > average), F.desc("d"))
    if kind == "corder-global":
        hot = numbered(deg.where(F.col("d") > average), F.col("community"), F.desc("d"), F.col("id"), name="r")
        cold = numbered(deg.where(F.col("d") <= average), F.col("community"), F.desc("d"), F.col("id"), name="r")
        nh, nc = hot.count(), cold.count()
        segments = max(1, -(-(nh + nc) // O.SEGMENT))
        quota = -(-nh // segments)
        rest = max(1, O.SEGMENT - quota)
        h = hot.select("id", F.floor(F.col("r") / max(1, quota)).alias("s"), F.lit(0).alias("k"), "r")
        c = cold.select("id", F.least(F.floor(F.col("r") / rest), F.lit(segments - 1)).alias("s"), F.lit(1).alias("k"), "r")
        return placed(h.union(c), F.col("s"), F.col("k"), F.col("r"))
    if kind in ("bfs", "conn", "dfs"):
        plan = replace(plan, intra_order="dendrogram" if kind == "dfs" else "bfs")
    elif kind in ("hrab", "hlr", "tqr", "hcache"):
        plan = replace(plan, super_order="super-rabbit")
    elif kind == "layer":
        plan = replace(plan, intra_order="bfs" if plan.intra_order == "bfs" else plan.intra_order)
    local = order_within(g, live, plan)
    return O.assembled(local, order_communities(g, live.select("id", "community"), plan), lone)


def layered(g: Graph, member: DataFrame, algorithm: Callable[[Graph], DataFrame], limit: int = 64) -> DataFrame:
    """Any ordering applied to each community's own graph, for at most `limit` communities (the largest first);
    the rest keep the order by degree. Communities follow each other by size."""
    ranks = cut(C.community_ranks(member, g))
    parts = None
    for r in ranks.where(F.col("rank") < limit).orderBy("rank").collect():
        ids = member.where(F.col("community") == r["community"]).select("id")
        e = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        done = algorithm(Graph(ids, e.select("src", "dst", "weight"), g.directed)).select(F.col("old_id").alias("id"), F.lit(r["community"]).alias("community"), F.col("new_id").alias("local"))
        parts = done if parts is None else parts.union(done)
    rest = member.join(ranks.where(F.col("rank") >= limit), "community", "left_semi").join(degrees(g), "id")
    tail = numbered(rest, F.col("community"), F.desc("out_degree"), F.col("id"), name="local").select("id", "community", "local")
    return O.assembled(tail if parts is None else parts.union(tail), ranks)


def same_topology(g: Graph, mapping: DataFrame) -> bool:
    """Whether the graph mapped and mapped back has the very same edges."""
    from loomgraph.operators.construct import relabelled

    there = relabelled(g, mapping)
    back = relabelled(there, mapping.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id")))
    a, b = g.edges.select("src", "dst", "weight"), back.edges.select("src", "dst", "weight")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


by_value(__name__)
