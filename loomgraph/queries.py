"""The registered graph queries and the SQL that gives the same rows.

Graphs: `month` (customers and suppliers of one month's lines, undirected, several
components), `all` (the same over all lines), `parts` (parts of one order) and
`users` (consecutive users, directed).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import features, metrics
from loomgraph.functions.scalar import hilbert, morton, varint_bytes, zigzag
from loomgraph.graph import Graph
from loomgraph.operators import cache, communities, construct, kernels, orderings, partition
from loomgraph.plans import compose, gas, selector
from loomgraph.runtime import cut_flat
from loomgraph.sources import generators, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = """
me AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1995-02-01'),
ms AS (SELECT src, dst FROM me UNION SELECT dst, src FROM me),
mv AS (SELECT DISTINCT src AS id FROM ms),
mw AS (SELECT src, dst, 1 + (src + dst) % 5 AS weight FROM ms),
ae AS (SELECT DISTINCT o_custkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
asym AS (SELECT src, dst FROM ae UNION ALL SELECT dst, src FROM ae),
av AS (SELECT DISTINCT src AS id FROM asym),
ad AS (SELECT src AS id, count(*) AS d FROM asym GROUP BY src),
ue AS (SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst),
uv AS (SELECT DISTINCT id FROM (SELECT src AS id FROM ue UNION ALL SELECT dst FROM ue)),
ud AS (SELECT id, (SELECT count(*) FROM ue WHERE src = id) AS o, (SELECT count(*) FROM ue WHERE dst = id) AS i FROM uv),
pe AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey < b.l_partkey)
"""


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a query, with the SQL of the same rows after the shared views."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS}{sql}"
        return f

    return keep


def month(spark: SparkSession, sf: str) -> Graph:
    return Graph.from_edges(tables.month(spark, sf), directed=False)


def weighted_month(spark: SparkSession, sf: str) -> Graph:
    return Graph.from_edges(tables.month(spark, sf).withColumn("weight", 1 + (F.col("src") + F.col("dst")) % 5), directed=False)


def everything(spark: SparkSession, sf: str) -> Graph:
    return Graph.from_edges(tables.customer_supplier(spark, sf), directed=False)


def users(spark: SparkSession, sf: str) -> Graph:
    return Graph.from_edges(tables.user_next(spark, sf))


def parts(spark: SparkSession, sf: str) -> Graph:
    return Graph.from_edges(tables.parts_together(spark, sf), directed=False)


def dense_users(spark: SparkSession, sf: str) -> Graph:
    return Graph.dense(tables.user_next(spark, sf))


DENSE = """,
n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM ue),
dv AS (SELECT unnest(range(0, (SELECT n FROM n))) AS id),
dd AS (SELECT id, coalesce(o, 0) AS d, coalesce(i, 0) AS i FROM dv LEFT JOIN ud USING (id)),
avgd AS (SELECT (SELECT count(*) FROM ue) // (SELECT n FROM n) AS a)
"""


# --- construction -----------------------------------------------------------------------------


@query("gc1_vertex_count", ", x AS (SELECT 1) SELECT max(greatest(src, dst)) + 1 AS n FROM ms")
def _(spark, sf):
    return construct.vertex_count(month(spark, sf).edges)


@query("gc2_degrees", ", x AS (SELECT 1) SELECT id, d::BIGINT AS out_degree, d::BIGINT AS in_degree FROM ad")
def _(spark, sf):
    return construct.degrees(everything(spark, sf))


@query("gc3_offsets", ", x AS (SELECT 1) SELECT id, (sum(o) OVER (ORDER BY id) - o)::BIGINT AS start FROM ud")
def _(spark, sf):
    return construct.offsets(users(spark, sf))


@query("gc4_simplified", ", x AS (SELECT s_nationkey AS s, c_nationkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey) SELECT s::BIGINT AS src, c::BIGINT AS dst, count(*)::BIGINT AS weight FROM x WHERE s <> c GROUP BY s, c")
def _(spark, sf):
    return construct.simplified(tables.nation_trade(spark, sf))


@query("gc5_rows", ", x AS (SELECT 1) SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM ue GROUP BY src")
def _(spark, sf):
    return construct.rows(users(spark, sf)).withColumn("neighbours", F.array_join("neighbours", ","))


@query("gc6_symmetrized", ", x AS (SELECT 1) SELECT src, dst FROM ue UNION SELECT dst, src FROM ue")
def _(spark, sf):
    return construct.symmetrized(tables.user_next(spark, sf))


@query("gc7_transposed", ", x AS (SELECT 1) SELECT dst AS src, src AS dst, 1::BIGINT AS weight FROM ue")
def _(spark, sf):
    return construct.transposed(users(spark, sf)).edges


@query("gc8_self_loops", ", x AS (SELECT DISTINCT s_nationkey AS s, c_nationkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey) SELECT count(*) AS loops FROM x WHERE s = c")
def _(spark, sf):
    return construct.self_loops(tables.nation_trade(spark, sf))


@query("gc9_subgraph", ", x AS (SELECT 1) SELECT src, dst, 1::BIGINT AS weight FROM ue WHERE src % 3 <> 0 AND dst % 3 <> 0 AND src < dst")
def _(spark, sf):
    return construct.subgraph(users(spark, sf), F.col("id") % 3 != 0, F.col("src") < F.col("dst")).edges


@query("gc10_induced", ", x AS (SELECT id, id % 10 AS c, row_number() OVER (PARTITION BY id % 10 ORDER BY id) - 1 AS l FROM uv) SELECT a.c AS community, a.l::BIGINT AS src, b.l::BIGINT AS dst, 1::BIGINT AS weight FROM ue JOIN x a ON a.id = src JOIN x b ON b.id = dst WHERE a.c = b.c")
def _(spark, sf):
    g = users(spark, sf)
    return construct.induced(g, g.vertices.withColumn("community", F.col("id") % 10))


_SORT = "(row_number() OVER (ORDER BY d DESC, id) - 1)::BIGINT"


@query("gc11_relabelled", f", x AS (SELECT id, {_SORT} AS p FROM ad) SELECT a.p AS src, b.p AS dst, 1::BIGINT AS weight FROM asym JOIN x a ON a.id = src JOIN x b ON b.id = dst")
def _(spark, sf):
    g = everything(spark, sf).cut()
    return construct.relabelled(g, orderings.by_degree(g)).edges


@query("gc12_chained", f", x AS (SELECT id, {_SORT} AS p, d FROM ad) SELECT id AS old_id, (row_number() OVER (ORDER BY d, p) - 1)::BIGINT AS new_id FROM x")
def _(spark, sf):
    g = everything(spark, sf).cut()
    first = orderings.by_degree(g)
    return construct.composed(first, orderings.by_degree(construct.relabelled(g, first), ascending=True))


@query("gc13_weakly_flat", ", x AS (SELECT src, dst FROM ue UNION ALL SELECT dst, src FROM ue) SELECT src, dst, count(*) AS n FROM x GROUP BY src, dst")
def _(spark, sf):
    return construct.weakly_flat(users(spark, sf)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("gc14_incoming", ", x AS (SELECT 1) SELECT dst AS src, src AS dst, 1::BIGINT AS weight FROM ue")
def _(spark, sf):
    return construct.flat(users(spark, sf), incoming=True)


@query("gc15_oriented", ", x AS (SELECT 1) SELECT src, dst, 1::BIGINT AS weight FROM asym WHERE src < dst")
def _(spark, sf):
    return construct.oriented(everything(spark, sf).edges)


@query("gc16_batch", ", x AS (SELECT src, dst, 1 AS weight FROM ue WHERE (src + dst) % 7 <> 0), y AS (SELECT DISTINCT src, dst + 1 AS dst FROM ue WHERE src % 5 = 0 AND src <> dst + 1) SELECT src, dst, weight::BIGINT AS weight FROM x WHERE (src, dst) NOT IN (SELECT (src, dst) FROM y) UNION ALL SELECT src, dst, 9::BIGINT FROM y")
def _(spark, sf):
    g = users(spark, sf)
    new = g.edges.where("src % 5 = 0").select("src", (F.col("dst") + 1).alias("dst"), F.lit(9).cast("long").alias("weight"))
    return construct.applied_batch(g, g.edges.where("(src + dst) % 7 = 0"), new).edges


@query("gc17_random_changes")
def _(spark, sf):
    g = users(spark, sf).cut()
    return construct.random_deletions(g, 100).withColumn("op", F.lit("-")).union(construct.random_insertions(g, 100, 1000).withColumn("op", F.lit("+")))


@query("gc18_slices", DENSE + ", s AS (SELECT n // 4 AS q, n % 4 AS r FROM n) SELECT src, dst, 1::BIGINT AS weight, (CASE WHEN dst < r * (q + 1) THEN dst // (q + 1) ELSE r + (dst - r * (q + 1)) // q END)::BIGINT AS slice FROM ue, s")
def _(spark, sf):
    g = dense_users(spark, sf)
    return construct.slices(g, construct.vertex_count(g.edges).first()[0], 4)


@query("gc19_tiles", ", x AS (SELECT 1) SELECT src, (dst // 64)::BIGINT AS tile, count(*) AS n FROM asym GROUP BY 1, 2")
def _(spark, sf):
    return construct.tiles(everything(spark, sf), 64).groupBy("src", "tile").agg(F.count("*").alias("n"))


@query("gc20_degree_classes", ", x AS (SELECT 1) SELECT id, d::BIGINT AS degree, (CASE WHEN d > 100 THEN 0 WHEN d >= 2 THEN 1 ELSE 2 END)::BIGINT AS class FROM ad")
def _(spark, sf):
    return construct.degree_classes(everything(spark, sf))


@query("gc20_degree_oriented", ", x AS (SELECT src, dst, a.d AS ds, b.d AS dd FROM ae JOIN ad a ON a.id = src JOIN ad b ON b.id = dst), y AS (SELECT *, ds < dd OR (ds = dd AND src < dst) AS up FROM x) SELECT CASE WHEN up THEN src ELSE dst END AS src, CASE WHEN up THEN dst ELSE src END AS dst FROM y")
def _(spark, sf):
    return construct.degree_oriented(everything(spark, sf))


_CLASS = "(row_number() OVER (ORDER BY CASE WHEN d > 100 THEN 0 WHEN d >= 2 THEN 1 ELSE 2 END, d DESC, id) - 1)::BIGINT"


@query("gc20_tiled", f", r AS (SELECT id, {_CLASS} AS r FROM ad), x AS (SELECT src, dst, a.d < b.d OR (a.d = b.d AND src < dst) AS up FROM ae JOIN ad a ON a.id = src JOIN ad b ON b.id = dst), y AS (SELECT CASE WHEN up THEN src ELSE dst END AS s, CASE WHEN up THEN dst ELSE src END AS d FROM x) SELECT a.r AS src, b.r AS dst, (a.r % 3 * 2 + b.r % 2)::BIGINT AS tile FROM y JOIN r a ON a.id = s JOIN r b ON b.id = d")
def _(spark, sf):
    return construct.tiled_partition(everything(spark, sf).cut(), 3, 2)


_BFS = """, s AS (SELECT min(id) AS s FROM mv),
r AS (SELECT s AS id, 0 AS depth FROM s UNION SELECT dst, depth + 1 FROM r JOIN ms ON src = id WHERE depth < 40),
t AS (SELECT id, min(depth)::BIGINT AS depth FROM r GROUP BY id)
"""


@query("gc21_reachable", """, s AS (SELECT min(id) AS s FROM mv), f AS (SELECT ms.* FROM ms, s WHERE (src % 7 <> 1 OR src = s) AND (dst % 7 <> 1 OR dst = s)),
r AS (SELECT s AS id FROM s UNION SELECT dst FROM r JOIN f ON src = id) SELECT id FROM r""", True)
def _(spark, sf):
    g = month(spark, sf).cut()
    s = g.vertices.agg(F.min("id")).first()[0]
    return kernels.bfs(construct.subgraph(g, (F.col("id") % 7 != 1) | (F.col("id") == s)).cut(), s).select("id")


# --- kernels ----------------------------------------------------------------------------------


def _first(g: Graph) -> int:
    return g.vertices.agg(F.min("id")).first()[0]


def _pagerank_sql(rounds: int, edges: str, vertices: str) -> str:
    out = f", n AS (SELECT count(*)::DOUBLE AS n FROM {vertices}), w AS (SELECT src, 1.0 / count(*) AS w FROM {edges} GROUP BY src), r0 AS (SELECT id, 1.0 / n AS score FROM {vertices}, n)"
    for k in range(1, rounds + 1):
        out += f", r{k} AS MATERIALIZED (SELECT v.id, (1 - 0.85) / n + 0.85 * coalesce(s, 0) AS score FROM {vertices} v CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(r.score * w.w) AS s FROM {edges} e JOIN w ON w.src = e.src JOIN r{k - 1} r ON r.id = e.src GROUP BY e.dst) c ON c.dst = v.id)"
    return out + f" SELECT id, round(score, 9) AS score FROM r{rounds}"


@query("k2_pagerank", _pagerank_sql(10, "asym", "av"))
def _(spark, sf):
    rank, _info = kernels.pagerank(everything(spark, sf).cut(), 10, fixed_work=True)
    return rank.withColumn("score", F.round("score", 9))


@query("k2_pagerank_directed", _pagerank_sql(10, "ue", "uv"))
def _(spark, sf):
    rank, _info = kernels.pagerank(users(spark, sf).cut(), 10, fixed_work=True)
    return rank.withColumn("score", F.round("score", 9))


@query("k1_pagerank_converged", ", x AS (SELECT 1) SELECT (SELECT count(*) FROM mv) AS n, true AS converged, true AS verified")
def _(spark, sf):
    g = month(spark, sf).cut()
    rank, info = kernels.pagerank(g, 100, 1e-4)
    good = kernels.pagerank_residual(g, rank) < 1e-4
    return rank.agg(F.count("*").alias("n")).withColumns({"converged": F.lit(info["converged"]), "verified": F.lit(good)})


@query("k4_bfs", _BFS + "SELECT t.id, t.depth, coalesce(min(p.id), t.id) AS parent FROM t LEFT JOIN ms ON ms.dst = t.id LEFT JOIN t p ON p.id = ms.src AND p.depth = t.depth - 1 GROUP BY t.id, t.depth", True)
def _(spark, sf):
    g = month(spark, sf).cut()
    return kernels.bfs(g, _first(g))


@query("k5_bfs_stats", _BFS + ", d AS (SELECT src, count(*) AS c FROM ms GROUP BY src) SELECT count(*) AS tree_nodes, sum(c)::BIGINT AS tree_edges FROM t JOIN d ON d.src = t.id", True)
def _(spark, sf):
    g = month(spark, sf).cut()
    return kernels.bfs_stats(g, kernels.bfs(g, _first(g)))


_CC = ", r AS (SELECT id AS a, id AS b FROM mv UNION SELECT a, dst FROM r JOIN ms ON src = b), c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a) "


@query("k6_components", _CC + "SELECT id, component FROM c", True)
def _(spark, sf):
    return kernels.components(month(spark, sf).cut())


@query("k7_components_sv", _CC + "SELECT id, component FROM c", True)
def _(spark, sf):
    return kernels.components_sv(month(spark, sf).cut())


@query("k8_component_stats", _CC + "SELECT component, count(*) AS size FROM c GROUP BY component ORDER BY size DESC, component LIMIT 5", True)
def _(spark, sf):
    return kernels.component_stats(kernels.components(month(spark, sf).cut()))


_SSSP = """, s AS (SELECT min(id) AS s FROM mv),
r AS (SELECT s AS id, 0 AS dist, 0 AS hops FROM s UNION (SELECT dst, min(dist + weight), hops + 1 FROM r JOIN mw ON src = id WHERE hops < 60 GROUP BY dst, hops)),
t AS (SELECT id, min(dist)::BIGINT AS dist FROM r GROUP BY id)
"""


@query("k9_sssp", _SSSP + "SELECT id, dist FROM t", True)
def _(spark, sf):
    g = weighted_month(spark, sf).cut()
    return kernels.sssp(g, _first(g))


@query("k10_sssp_stats", _SSSP + "SELECT count(*) AS reachable, sum(dist)::BIGINT AS total FROM t", True)
def _(spark, sf):
    g = weighted_month(spark, sf).cut()
    return kernels.sssp_stats(kernels.sssp(g, _first(g))).drop("fingerprint")


@query("k11_betweenness")
def _(spark, sf):
    g = month(spark, sf).cut()
    ends = g.vertices.agg(F.min("id"), F.max("id")).first()
    return kernels.betweenness(g, [ends[0], ends[1]]).withColumn("score", F.round("score", 9))


@query("k12_triangles", ", x AS (SELECT 1) SELECT count(*) AS total FROM pe a JOIN pe b ON a.dst = b.src JOIN pe c ON c.src = a.src AND c.dst = b.dst")
def _(spark, sf):
    return kernels.triangles(parts(spark, sf))


@query("k22_triangles_tiled", ", x AS (SELECT 1) SELECT count(*) AS total FROM pe a JOIN pe b ON a.dst = b.src JOIN pe c ON c.src = a.src AND c.dst = b.dst")
def _(spark, sf):
    return kernels.triangles_by_tile(parts(spark, sf), 3, 2).agg(F.sum("triangles").alias("total"))


@query("k20_gas_pagerank", _pagerank_sql(5, "ue", "uv"))
def _(spark, sf):
    return gas.pagerank(users(spark, sf).cut(), 5, fixed_work=True).withColumn("score", F.round("score", 9))


@query("k20_gas_components", _CC + "SELECT id, component FROM c", True)
def _(spark, sf):
    return gas.components(month(spark, sf).cut())


@query("k20_gas_sssp", _SSSP + "SELECT id, dist FROM t", True)
def _(spark, sf):
    g = weighted_month(spark, sf).cut()
    return gas.sssp(g, _first(g))


@query("k21_bfs_traffic", _BFS + ", f AS (SELECT depth, count(*) AS frontier FROM t GROUP BY depth), x AS (SELECT depth, count(*) AS remote FROM t JOIN ms ON src = t.id WHERE src % 4 <> dst % 4 GROUP BY depth) SELECT f.depth, frontier, coalesce(remote, 0)::BIGINT AS remote FROM f LEFT JOIN x USING (depth)", True)
def _(spark, sf):
    g = month(spark, sf).cut()
    return kernels.bfs_traffic(g, _first(g), g.vertices.withColumn("owner", F.col("id") % 4))


@query("k25_octile_sources", _CC + """, z AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
d AS (SELECT src, count(*) AS d FROM ms GROUP BY src),
k AS (SELECT id, row_number() OVER (ORDER BY d, id) - 1 AS r, count(*) OVER () AS n FROM c JOIN d ON d.src = id WHERE component = (SELECT component FROM z)),
o AS (SELECT id, r, r * 8 // n AS octile FROM k)
SELECT octile::BIGINT AS octile, min_by(id, r) AS id FROM o GROUP BY octile""", True)
def _(spark, sf):
    return kernels.octile_sources(month(spark, sf).cut())


# --- orderings --------------------------------------------------------------------------------


def _order(name: str, build: Callable[[Graph], DataFrame], key: str | None, base: Callable = dense_users) -> None:
    sql = None if key is None else DENSE + f" SELECT id AS old_id, (row_number() OVER (ORDER BY {key}) - 1)::BIGINT AS new_id FROM dd, avgd"
    query(name, sql)(lambda spark, sf: build(base(spark, sf).cut()))


_BUCKET = "CASE WHEN d <= a // 2 THEN 0 WHEN d <= a THEN 1 WHEN d <= 2 * a THEN 2 WHEN d <= 4 * a THEN 3 WHEN d <= 8 * a THEN 4 WHEN d <= 16 * a THEN 5 WHEN d <= 32 * a THEN 6 ELSE 7 END"
_order("ord0_original", orderings.original, "id")
_order("ord2_degree", orderings.by_degree, "d DESC, id")
_order("ord2_degree_ascending", lambda g: orderings.by_degree(g, True), "d, id")
_order("ord2b_both_degrees", orderings.by_both_degrees, "(d + i = 0)::INT, d DESC, i DESC, id")
_order("ord5_degree_buckets", orderings.degree_buckets, f"{_BUCKET} DESC, id")
_order("ord6_hubs_sorted_packed", orderings.hubs_sorted_packed, "(d > a)::INT DESC, CASE WHEN d > a THEN -d ELSE 0 END, CASE WHEN d > a THEN -id ELSE id END")
_order("ord7_hubs_clustered_packed", orderings.hubs_clustered_packed, "(d > a)::INT DESC, id")

_FILL = """,
hub AS (SELECT id, row_number() OVER (ORDER BY {key}) - 1 AS r FROM dd, avgd WHERE d > a),
h AS (SELECT count(*) AS h FROM hub),
swap AS (SELECT hub.r AS id, hub.id AS pos FROM hub, h WHERE hub.id >= h AND hub.r NOT IN (SELECT id FROM hub)),
free AS (SELECT hub.id AS pos, row_number() OVER (ORDER BY hub.id) AS k FROM hub, h WHERE hub.id >= h AND hub.id NOT IN (SELECT pos FROM swap)),
lost AS (SELECT dv.id, row_number() OVER (ORDER BY dv.id) AS k FROM dv, h WHERE dv.id < h AND dv.id NOT IN (SELECT id FROM hub) AND dv.id NOT IN (SELECT id FROM swap))
SELECT id AS old_id, r::BIGINT AS new_id FROM hub UNION ALL SELECT id, pos::BIGINT FROM swap UNION ALL SELECT lost.id, pos::BIGINT FROM lost JOIN free USING (k)
UNION ALL SELECT dv.id, dv.id FROM dv, h WHERE dv.id >= h AND dv.id NOT IN (SELECT id FROM hub)
"""


@query("ord3_hubs_sorted", DENSE + _FILL.format(key="d DESC, id DESC"))
def _(spark, sf):
    return orderings.hubs_sorted(dense_users(spark, sf).cut())


@query("ord4_hubs_clustered", DENSE + _FILL.format(key="id"))
def _(spark, sf):
    return orderings.hubs_clustered(dense_users(spark, sf).cut())


@query("ord10_hot_cold", DENSE + """,
x AS (SELECT id, d > a AS hot, row_number() OVER (PARTITION BY d > a ORDER BY id) - 1 AS r FROM dd, avgd),
c AS (SELECT count(*) FILTER (hot) AS l, count(*) FILTER (NOT hot) AS s, greatest(1, (count(*) + 63) // 64) AS p FROM x),
q AS (SELECT *, (l + p - 1) // p AS q, 64 - (l + p - 1) // p AS t FROM c),
k AS (SELECT *, least(p - 1, l // q, s // t) AS k FROM q)
SELECT id AS old_id, (row_number() OVER (ORDER BY least(k, CASE WHEN hot THEN r // q ELSE r // t END), hot::INT DESC, r) - 1)::BIGINT AS new_id FROM x, k""")
def _(spark, sf):
    return orderings.hot_cold(dense_users(spark, sf).cut(), 64)


def _forward_sql(rounds: int) -> str:
    out = DENSE + ", f0 AS (SELECT id, id AS p FROM dv)"
    for k in range(1, rounds + 1):
        out += f", f{k} AS MATERIALIZED (SELECT dd.id, row_number() OVER (ORDER BY coalesce(s, 0.5) DESC, d DESC, dd.id) - 1 AS p FROM dd LEFT JOIN (SELECT src, avg((b.p > a.p)::INT) AS s FROM ue JOIN f{k - 1} a ON a.id = src JOIN f{k - 1} b ON b.id = dst GROUP BY src) x ON x.src = dd.id)"
    return out + f" SELECT id AS old_id, p::BIGINT AS new_id FROM f{rounds}"


@query("ord16_forward_fraction", _forward_sql(3))
def _(spark, sf):
    return orderings.forward_fraction(dense_users(spark, sf).cut())


def _proof(g: Graph, mapping: DataFrame) -> DataFrame:
    """A permutation's verification row: its size, whether it is one, and the mean gap along edges."""
    mapping = mapping.cache()
    good = construct.is_bijection(mapping).join(F.broadcast(metrics.layout(g, mapping).select(F.round("gap_mean", 6).alias("gap_mean"))))
    return good.withColumn("same_topology", F.lit(compose.same_topology(g, mapping)))


def _greedy(name: str, build: Callable[[Graph], DataFrame]) -> None:
    @query(name)
    def _(spark, sf):
        g = month(spark, sf).cut()
        return _proof(g, build(g))


_greedy("ord1_random", orderings.random)
_greedy("ord8_rabbit", communities.rabbit)
_greedy("ord9_greedy_window", orderings.greedy_window)
_greedy("ord11_cuthill_mckee", orderings.reverse_cuthill_mckee)
_greedy("ord12_compose_size_bfs", lambda g: compose.ordering(g, "leiden:compose:comm_size_desc:intra_bfs:2:1"))
_greedy("ord12_compose_cut_core", lambda g: compose.ordering(g, "cd_lp:compose:comm_cut_min:intra_core"))
_greedy("ord12_rabbit_dendrogram", lambda g: compose.ordering(g, "rabbit:compose:comm_degree_desc:intra_dendrogram"))
_greedy("ord12_community_sort", lambda g: compose.ordering(g, "cd_lp:community"))


@query("ord13_given_mapping", DENSE + " SELECT id AS old_id, (n - 1 - id)::BIGINT AS new_id FROM dv, n")
def _(spark, sf):
    g = dense_users(spark, sf).cut()
    top = g.vertices.agg(F.max("id")).first()[0]
    return orderings.read_mapping(g.vertices.select(F.col("id").alias("old_id"), (F.lit(top) - F.col("id")).alias("new_id")), g)


# --- communities and statistics ----------------------------------------------------------------

_M10 = ", m AS (SELECT id, id % 10 AS c FROM uv) "


def _tenths(g: Graph) -> DataFrame:
    return g.vertices.withColumn("community", F.col("id") % 10)


@query("ag3_community_sizes", _M10 + "SELECT c AS community, count(*) AS size FROM m GROUP BY c")
def _(spark, sf):
    return communities.sizes(_tenths(users(spark, sf)))


@query("ag3_community_degrees", _M10 + "SELECT c AS community, sum(o)::BIGINT AS total_degree FROM m JOIN ud USING (id) GROUP BY c")
def _(spark, sf):
    g = users(spark, sf)
    return communities.total_degrees(g, _tenths(g))


@query("ag4_disconnected", """, m AS (SELECT id, id % 4 AS c FROM mv), e AS (SELECT src, dst FROM ms WHERE src % 4 = dst % 4),
r AS (SELECT id AS a, id AS b FROM mv UNION SELECT a, dst FROM r JOIN e ON src = b), k AS (SELECT a AS id, min(b) AS l FROM r GROUP BY a)
SELECT c AS community, count(DISTINCT l) AS parts FROM m JOIN k USING (id) GROUP BY c HAVING count(DISTINCT l) > 1""", True)
def _(spark, sf):
    g = month(spark, sf).cut()
    return communities.disconnected(g, g.vertices.withColumn("community", F.col("id") % 4))


@query("ag5_modularity", """, m AS (SELECT src % 10 AS c, count(*) FILTER (src % 10 = dst % 10) AS i, count(*) AS t FROM asym GROUP BY 1)
SELECT round(sum(i) / sum(t) - sum(t::DOUBLE * t) / (sum(t)::DOUBLE * sum(t)), 9) AS modularity FROM m""")
def _(spark, sf):
    g = everything(spark, sf)
    return communities.modularity(g, _tenths(g)).select(F.round("modularity", 9).alias("modularity"))


@query("ag6_adjacent_modularity", ", m AS (SELECT count(*)::DOUBLE AS m FROM asym) SELECT round(sum(CASE WHEN src % 10 = dst % 10 THEN 1 - a.d * b.d / m ELSE 0 END) / any_value(m), 9) AS modularity FROM asym JOIN ad a ON a.id = src JOIN ad b ON b.id = dst, m")
def _(spark, sf):
    g = everything(spark, sf).cut()
    return communities.adjacent_modularity(g, _tenths(g)).select(F.round("modularity", 9).alias("modularity"))


@query("ag7_auto_resolution", """, x AS (SELECT avg(d) AS a, stddev_pop(d) / avg(d) AS cv FROM ad), y AS (SELECT cv, least(1.2, greatest(0.5, 0.5 + 0.25 * log10(a + 1))) AS r FROM x)
SELECT round(CASE WHEN cv > 2 THEN greatest(0.5, r * 2 / greatest(2.0, sqrt(cv))) ELSE r END, 9) AS resolution FROM y""")
def _(spark, sf):
    return spark.createDataFrame([(round(communities.auto_resolution(everything(spark, sf)), 9),)], "resolution double")


@query("ag8_weight_total", ", x AS (SELECT 1) SELECT sum(weight)::BIGINT AS total FROM mw")
def _(spark, sf):
    return weighted_month(spark, sf).edges.agg(F.sum("weight").alias("total"))


@query("ag9_component_count", _CC + "SELECT count(DISTINCT component) AS n FROM c", True)
def _(spark, sf):
    return kernels.components(month(spark, sf).cut()).agg(F.count_distinct("component").alias("n"))


@query("ag10_geometric_mean", ", x AS (SELECT 1) SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geometric_mean FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1")
def _(spark, sf):
    return metrics.geometric_mean(tables.table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag").withColumn("geometric_mean", F.round("geometric_mean", 4))


@query("ag11_hub_concentration", ", x AS (SELECT d, row_number() OVER (ORDER BY d DESC, id) - 1 AS r, count(*) OVER () AS n FROM ad) SELECT round(sum(CASE WHEN r < greatest(1, n // 10) THEN d ELSE 0 END) / sum(d), 9) AS share, round(stddev_pop(d) / avg(d), 9) AS cv FROM x")
def _(spark, sf):
    return features.hub_concentration(everything(spark, sf)).select(F.round("share", 9).alias("share"), F.round("cv", 9).alias("cv"))


def nations(spark: SparkSession, sf: str) -> Graph:
    """Suppliers of the same nation, each with each: groups that any detection has to find."""
    s = tables.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    a, b = s.select(F.col("s_suppkey").alias("src"), "s_nationkey"), s.select(F.col("s_suppkey").alias("dst"), "s_nationkey")
    return Graph.from_edges(a.join(b, "s_nationkey").where("src < dst").select("src", "dst"), directed=False)


def _detected(name: str, build: Callable[[Graph], DataFrame], held: Callable[[Graph], Graph] = Graph.cut) -> None:
    """Each vertex with the smallest id of its community, by the operator's default passes and rounds."""

    @query(name, ", x AS (SELECT 1) SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS community FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)")
    def _(spark, sf):
        found = cut_flat(build(held(nations(spark, sf))).select("id", "community"))
        return found.join(found.groupBy("community").agg(F.min("id").alias("least")), "community").select("id", F.col("least").alias("community"))

    @query(f"{name}_whole")
    def _(spark, sf):
        g = everything(spark, sf).cut()
        found = build(g).select("id", "community").cache()
        row = communities.modularity(g, found).first()
        return found.agg(F.count_distinct("id").alias("n"), F.count_distinct("community").alias("communities")).withColumn("modularity", F.lit(round(row[0], 6)))


_detected("cd1_leiden", lambda g: communities.leiden(g, 1.0))
_detected("cd4_incremental", communities.incremental_aggregation, Graph.flat)
_detected("cd7_louvain", lambda g: communities.louvain(g, 1.0)[0])
_detected("cd8_label_propagation", lambda g: communities.label_propagation(g, tolerance=0.0))


@query("cd2_super_graph", ", x AS (SELECT least(src % 10, dst % 10) AS s, greatest(src % 10, dst % 10) AS d FROM asym) SELECT s AS src, d AS dst, count(*) / 2.0 AS weight FROM x GROUP BY s, d")
def _(spark, sf):
    g = everything(spark, sf)
    return communities.super_graph(g, _tenths(g))


# --- features and metrics -----------------------------------------------------------------------


@query("f1_first_tier", DENSE + """,
s AS (SELECT n, least(n, greatest(1024, least(floor(sqrt(n))::BIGINT, 8192))) AS s FROM n),
p AS (SELECT ((2 * i + 1) * n) // (2 * s) AS id FROM s, (SELECT unnest(range(0, (SELECT s FROM s))) AS i)),
k AS (SELECT dd.id, d FROM p JOIN dd USING (id)),
h AS (SELECT id, d FROM k ORDER BY d DESC, id LIMIT (SELECT greatest(1, s // 10) FROM s)),
e AS (SELECT src, dst FROM ue JOIN k ON k.id = src),
b AS (SELECT avg(d) AS a, stddev_samp(d) AS sd, sum(d) AS t FROM k),
g AS (SELECT avg(abs(src - dst) / (SELECT n - 1 FROM n)) AS span, avg((abs(src // 8 - dst // 8) <= 1)::INT) AS w FROM e)
SELECT n AS nodes, (SELECT count(*) FROM ue) AS edges, round(a, 9) AS average_degree, round(sd / a, 9) AS degree_cv, round(a / (n - 1), 9) AS density,
  round((SELECT sum(d) FROM h) / t, 9) AS hub_share, round((SELECT count(*) / count(DISTINCT id // 8) FROM h), 9) AS packing, round(span, 9) AS edge_span, round(w, 9) AS window_overlap
FROM n, b, g""")
def _(spark, sf):
    row = features.first_tier(dense_users(spark, sf).cut())
    return row.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes))


@query("f2_extended")
def _(spark, sf):
    row = features.extended(parts(spark, sf).flat())
    return row.select(*(F.round(c, 9).alias(c) for c in row.columns))


@query("f3_path_lengths")
def _(spark, sf):
    return features.path_lengths(dense_users(spark, sf).cut(), 2).withColumn("average_path", F.round("average_path", 9))


@query("f4_per_community", _M10 + """, z AS (SELECT c, count(*) AS size FROM m GROUP BY c),
e AS (SELECT src % 10 AS c, count(*) FILTER (src % 10 = dst % 10) AS i, count(*) FILTER (src % 10 <> dst % 10) AS o FROM ue GROUP BY 1)
SELECT c AS community, size, coalesce(i, 0)::BIGINT AS inner_edges, coalesce(o, 0)::BIGINT AS cut_edges, round(coalesce(i, 0) / size, 9) AS average_degree,
  round(CASE WHEN size > 1 THEN coalesce(i, 0) / (size * (size - 1)) ELSE 0 END, 9) AS density FROM z LEFT JOIN e USING (c)""")
def _(spark, sf):
    g = users(spark, sf)
    return features.per_community(g, _tenths(g)).withColumns({"average_degree": F.round("average_degree", 9), "density": F.round("density", 9)})


@query("m1_layout", f""", x AS (SELECT id, {_SORT} AS p FROM ad), e AS (SELECT a.p AS s, b.p AS d, abs(a.p - b.p) AS g FROM asym JOIN x a ON a.id = src JOIN x b ON b.id = dst),
o AS (SELECT count(*) AS edges, avg(g) AS gm, quantile_cont(g, 0.95) AS g95, max(g) AS gx, avg(1 + floor(log2(greatest(g, 1)))) AS lb, avg((s // 8 = d // 8)::INT) AS sl FROM e),
r AS (SELECT s, count(DISTINCT d // 8) AS l, max(d) - min(d) AS w FROM e GROUP BY s)
SELECT edges, round(gm, 6) AS gap_mean, round(g95, 6) AS gap_p95, gx AS gap_max, round(lb, 6) AS log_bits, round(sl, 6) AS same_line,
  round((SELECT avg(l) FROM r), 6) AS lines_per_row, round((SELECT avg(w) FROM r), 6) AS row_span FROM o""")
def _(spark, sf):
    g = everything(spark, sf).cut()
    row = metrics.layout(g, orderings.by_degree(g))
    return row.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in row.dtypes))


@query("m1_neighbour_gaps", ", x AS (SELECT dst - lag(dst) OVER (PARTITION BY src ORDER BY dst) AS g FROM ue) SELECT count(g) AS gaps, round(avg(g), 9) AS mean_gap, sum(1 + floor(log2(greatest(g, 1))))::BIGINT AS bits FROM x WHERE g IS NOT NULL")
def _(spark, sf):
    g = users(spark, sf)
    return metrics.neighbour_gaps(g, orderings.original(g)).withColumn("mean_gap", F.round("mean_gap", 9))


@query("m2_divergence", f", x AS (SELECT id, {_SORT} AS p, (row_number() OVER (ORDER BY d, id) - 1)::BIGINT AS o, count(*) OVER () AS n FROM ad) SELECT round(sum(abs(p - o)) / any_value(n * n), 9) AS footrule, round(least(sum(abs(p - o)), sum(abs(p - (n - 1 - o)))) / any_value(n * n), 9) AS mirrored, round(avg((p <> o)::INT), 9) AS displacement FROM x")
def _(spark, sf):
    g = everything(spark, sf).cut()
    row = metrics.divergence(orderings.by_degree(g), orderings.by_degree(g, True))
    return row.select(*(F.round(c, 9).alias(c) for c in row.columns))


@query("m2_colocation", f", x AS (SELECT id, {_SORT} // 8 AS p, (row_number() OVER (ORDER BY d, id) - 1) // 8 AS o FROM ad) SELECT round(avg(((a.p = b.p) = (a.o = b.o))::INT), 9) AS agreement FROM asym JOIN x a ON a.id = src JOIN x b ON b.id = dst")
def _(spark, sf):
    g = everything(spark, sf).cut()
    return metrics.colocation(g, orderings.by_degree(g), orderings.by_degree(g, True)).select(F.round("agreement", 9).alias("agreement"))


@query("m3_amortised", ", x AS (SELECT o_orderkey, 10.0 + o_custkey % 7 AS b, 8.0 + o_custkey % 3 AS r, 1.0 + o_orderkey % 50 AS m FROM orders) SELECT o_orderkey, round(b / r, 9) AS speedup, round(CASE WHEN b > r THEN m / (b - r) END, 9) AS break_even, ceil(19 * m / r)::BIGINT AS efficient_uses, round(2 * b / (m + 2 * r), 9) AS speedup_at_2 FROM x")
def _(spark, sf):
    rows = tables.table(spark, sf, "orders").select("o_orderkey", (10.0 + F.col("o_custkey") % 7).alias("base_time"), (8.0 + F.col("o_custkey") % 3).alias("reordered_time"), (1.0 + F.col("o_orderkey") % 50).alias("mapping_time"))
    out = metrics.amortised(rows, (2,))
    return out.select("o_orderkey", F.round("speedup", 9).alias("speedup"), F.round("break_even", 9).alias("break_even"), "efficient_uses", F.round("speedup_at_2", 9).alias("speedup_at_2"))


@query("m4_performance_matrix", ", x AS (SELECT 1) SELECT l_returnflag AS graph, l_linestatus AS ordering, (l_suppkey % 3)::VARCHAR AS benchmark, median(l_quantity) AS time FROM lineitem GROUP BY 1, 2, 3")
def _(spark, sf):
    runs = tables.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("graph"), F.col("l_linestatus").alias("ordering"), (F.col("l_suppkey") % 3).cast("string").alias("benchmark"), F.lit("c").alias("condition"), F.col("l_quantity").alias("time_seconds"))
    return metrics.performance_matrix(runs)


@query("fn_scalar", ", x AS (SELECT DISTINCT o_custkey AS k FROM orders) SELECT k, (2 * k)::BIGINT AS zigzag, greatest(0, 2 * k - 1)::BIGINT AS zigzag_negative, (CASE WHEN k = 0 THEN 1 ELSE floor(log2(k) / 7) + 1 END)::INT AS varint_bytes FROM x")
def _(spark, sf):
    k = tables.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return k.select("k", zigzag(F.col("k")).alias("zigzag"), zigzag(-F.col("k")).alias("zigzag_negative"), varint_bytes(F.col("k")).alias("varint_bytes"))


@query("fn_curves")
def _(spark, sf):
    at = tables.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 64).alias("x"), F.floor(F.col("c_custkey") / 64).alias("y"))
    return at.select("c_custkey", hilbert("x", "y", 8).alias("hilbert"), morton(F.col("x"), F.col("y"), 8).alias("morton"))


# --- partitions, caches, selection, generators ---------------------------------------------------


@query("p1_balanced_ranges", DENSE + """,
w AS (SELECT id, d + i AS w, sum(d + i) OVER (ORDER BY id) AS u FROM dd), t AS (SELECT s, (SELECT max(u) FROM w) * (s + 1) / 4.0 AS t FROM (SELECT unnest(range(0, 3)) AS s)),
b AS (SELECT s, min_by(id, (abs(u - t), id)) + 1 AS e FROM w, t WHERE abs(u - t) <= w GROUP BY s)
SELECT s AS shard, lag(e, 1, 0) OVER (ORDER BY s) AS first, e AS end FROM (SELECT s, e FROM b UNION ALL SELECT 3, n FROM n)""")
def _(spark, sf):
    return partition.balanced_ranges(dense_users(spark, sf).cut(), 4)


@query("p2_ghosts", ", x AS (SELECT src % 4 AS shard, dst AS ghost FROM asym WHERE src % 4 <> dst % 4 UNION SELECT dst % 4, src FROM asym WHERE src % 4 <> dst % 4) SELECT shard, ghost FROM x")
def _(spark, sf):
    g = everything(spark, sf)
    return partition.ghosts(g, g.vertices.withColumn("owner", F.col("id") % 4))


@query("p5_ownership", """, o AS (SELECT id % 4 AS s, count(*) AS owned FROM uv GROUP BY 1),
a AS (SELECT src % 4 AS s, count(*) AS oe, count(*) FILTER (src % 4 <> dst % 4) AS ro FROM ue GROUP BY 1), b AS (SELECT dst % 4 AS s, count(*) AS ie, count(*) FILTER (src % 4 <> dst % 4) AS ri FROM ue GROUP BY 1),
h AS (SELECT s, count(*) AS g FROM (SELECT src % 4 AS s, dst AS v FROM ue WHERE src % 4 <> dst % 4 UNION SELECT dst % 4, src FROM ue WHERE src % 4 <> dst % 4) GROUP BY s)
SELECT s AS shard, owned, oe AS out_edges, ie AS in_edges, ro AS remote_out, ri AS remote_in, g AS ghosts, (16 * (owned + 1) + 4 * oe + 4 * ie + 8 * g + 4 * owned)::BIGINT AS bytes
FROM o JOIN a USING (s) JOIN b USING (s) JOIN h USING (s)""")
def _(spark, sf):
    g = users(spark, sf)
    return partition.ownership(g, g.vertices.withColumn("owner", F.col("id") % 4))


@query("p6_halo", """, h AS (SELECT src % 4 AS s, dst AS v FROM asym WHERE src % 4 <> dst % 4 UNION SELECT dst % 4, src FROM asym WHERE src % 4 <> dst % 4)
SELECT v % 4 AS owner, s AS shard, count(*) AS "values", (count(*) * 8)::BIGINT AS bytes FROM h GROUP BY 1, 2""")
def _(spark, sf):
    g = everything(spark, sf)
    return partition.halo_bytes(g, g.vertices.withColumn("owner", F.col("id") % 4))


@query("p4_community_owners")
def _(spark, sf):
    g = users(spark, sf).cut()
    return partition.community_owners(g, _tenths(g), 3)


@query("p3_ranges_after_order", DENSE + """, x AS (SELECT id, d + i AS w, row_number() OVER (ORDER BY d DESC, id) - 1 AS p FROM dd), y AS (SELECT id, w, sum(w) OVER (ORDER BY p) AS u, sum(w) OVER () AS t FROM x)
SELECT id, least(floor((u - w / 2.0) * 4 / t), 3)::BIGINT AS owner FROM y""")
def _(spark, sf):
    g = dense_users(spark, sf).cut()
    return partition.contiguous_after(g, orderings.by_degree(g), 4)


@query("p7_fingerprint")
def _(spark, sf):
    return partition.fingerprint(users(spark, sf))


@query("r8_owner_comparison")
def _(spark, sf):
    g = dense_users(spark, sf).cut()
    found = communities.label_propagation(Graph(g.vertices, construct.weakly_flat(g), False))
    out = None
    for name, owners in (("contiguous", partition.range_owners(g, partition.balanced_ranges(g, 4))), ("community", partition.community_owners(g, found, 4))):
        row = partition.ownership_summary(partition.ownership(g, owners)).withColumn("owners", F.lit(name))
        out = row if out is None else out.union(row)
    return out.withColumns({"remote_fraction": F.round("remote_fraction", 9), "imbalance": F.round("imbalance", 9)})


@query("cs1_cache_hierarchy")
def _(spark, sf):
    g = dense_users(spark, sf).cut()
    levels = [cache.Level("L1", 1024, 4), cache.Level("L2", 4096, 8, policy="srrip")]
    return cache.hierarchy(cache.gather_trace(g), levels).withColumn("miss_rate", F.round("miss_rate", 9))


@query("cs4_reuse_gaps", DENSE + """, t AS (SELECT (sum(d) OVER (ORDER BY id) - d) AS s, id FROM dd), a AS (SELECT t.s + row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos, dst * 4 // 64 AS l FROM ue JOIN t ON t.id = src),
g AS (SELECT pos - lag(pos) OVER (PARTITION BY l ORDER BY pos) AS gap FROM a) SELECT gap::BIGINT AS gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap""")
def _(spark, sf):
    return cache.reuse_gaps(cache.gather_trace(dense_users(spark, sf)))


@query("sel1_low_reuse", ", x AS (SELECT o_orderkey AS k, 500 + o_custkey AS n, 1.0 + o_custkey % 90 AS d, (o_orderkey % 100) / 10.0 AS cv, (o_orderkey % 40) / 10.0 AS w FROM orders) SELECT k, n >= 1000 AND w <= 3.2 AND ((cv <= 2.68 AND (d <= 60 OR w <= 0.82)) OR cv > 8.0) AS chosen FROM x")
def _(spark, sf):
    o = tables.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (500 + F.col("o_custkey")).alias("n"), (1.0 + F.col("o_custkey") % 90).alias("d"), (F.col("o_orderkey") % 100 / 10.0).alias("cv"), (F.col("o_orderkey") % 40 / 10.0).alias("w"))
    return o.select("k", selector.low_reuse_column(F.col("n"), F.col("d"), F.col("cv"), F.col("w"), F.lit(1.0)).alias("chosen"))


@query("sel1_choice")
def _(spark, sf):
    c = selector.choose(dense_users(spark, sf).cut(), "pr")
    return spark.createDataFrame([(c.spec, c.matched, c.reason)], "spec string, matched boolean, reason string")


@query("sel8_regret", ", x AS (SELECT l_returnflag AS graph, (l_suppkey % 2)::VARCHAR AS benchmark, l_shipdate, l_linestatus AS arm, l_orderkey, l_linenumber, l_quantity AS time FROM lineitem) SELECT l_orderkey, l_linenumber, round(time / min(time) OVER (PARTITION BY graph, benchmark) - 1, 9) AS regret FROM x")
def _(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("graph"), (F.col("l_suppkey") % 2).cast("string").alias("benchmark"), F.col("l_quantity").alias("time"))
    return selector.regret(rows).select("l_orderkey", "l_linenumber", F.round("regret", 9).alias("regret"))


@query("io6_kronecker")
def _(spark, sf):
    return construct.degrees(Graph.from_edges(generators.kronecker(spark, 10, 8), directed=False))


@query("io8_grid", ", v AS (SELECT unnest(range(0, 1024)) AS i) SELECT i AS src, i + 1 AS dst FROM v WHERE i % 32 < 31 UNION ALL SELECT i, i + 32 FROM v WHERE i < 992")
def _(spark, sf):
    return generators.grid(spark, 1024)


@query("io8_hub_spoke", ", v AS (SELECT unnest(range(0, 1024)) AS i), h AS (SELECT i, (i + 32) % 1024 AS o FROM v WHERE i % 32 = 0) SELECT i - i % 32 AS src, i AS dst FROM v WHERE i % 32 <> 0 UNION ALL SELECT DISTINCT least(i, o), greatest(i, o) FROM h WHERE i <> o")
def _(spark, sf):
    return generators.hub_spoke(spark, 1024)


@query("io8_biclique", ", v AS (SELECT unnest(range(0, 256)) AS i) SELECT a.i AS src, b.i AS dst FROM v a JOIN v b ON a.i // 32 = b.i // 32 WHERE a.i % 32 < 16 AND b.i % 32 >= 16")
def _(spark, sf):
    return generators.block_biclique(spark, 256)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Degree-bucket order, the graph under it, ten rounds of PageRank, and the ten best by original id."""
    g = everything(spark, sf).cut()
    mapping = orderings.degree_buckets(g)
    rank, _info = kernels.pagerank(construct.relabelled(g, mapping).cut(), 10, fixed_work=True)
    back = rank.join(mapping, rank["id"] == mapping["new_id"]).select(F.col("old_id").alias("id"), F.round("score", 9).alias("score"))
    return back.orderBy(F.desc("score"), "id").limit(10)


query("flagship_pagerank_top", _pagerank_sql(10, "asym", "av").replace(" SELECT id, round", ", z AS (SELECT id, round") + ") SELECT id, score FROM z ORDER BY score DESC, id LIMIT 10")(flagship)
