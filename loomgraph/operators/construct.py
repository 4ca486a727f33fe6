"""Graph construction, projection and filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import Graph, numbered, reverse


def vertex_count(edges: DataFrame) -> DataFrame:
    """n = greatest id + 1 (0 without edges)."""
    return edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).alias("n"))


def degrees(g: Graph) -> DataFrame:
    """(id, out_degree, in_degree); vertices without edges have 0. One shuffle of partial counts."""
    ends = g.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.union(g.edges.select("dst", F.lit(0), F.lit(1))).union(g.vertices.select("id", F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def offsets(g: Graph, block: int = 65_536) -> DataFrame:
    """(id, start): where each vertex's edges begin when laid out by id. Prefix sums in two
    levels: blocks of ids, and within them."""
    return starts(degrees(g), block)


def starts(d: DataFrame, block: int = 65_536) -> DataFrame:
    """(id, start): the sums of out_degree over smaller ids."""
    d = d.select("id", "out_degree", F.floor(F.col("id") / block).alias("b"))
    blocks = d.groupBy("b").agg(F.sum("out_degree").alias("s"))
    before = blocks.withColumn("before", F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).drop("s")
    within = F.sum("out_degree").over(Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("w", within).join(before, "b").select("id", (F.col("before") + F.col("w") - F.col("out_degree")).alias("start"))


def rows(g: Graph) -> DataFrame:
    """(id, neighbours): each vertex's sorted neighbour list."""
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def simplified(edges: DataFrame) -> DataFrame:
    """No loops and no repeats; the least weight stays."""
    rest = [F.min(c).alias(c) for c in edges.columns if c not in ("src", "dst")]
    kept = edges.where("src <> dst")
    return kept.groupBy("src", "dst").agg(*rest) if rest else kept.distinct()


def symmetrized(edges: DataFrame) -> DataFrame:
    return simplified(edges.unionByName(reverse(edges)))


def transposed(g: Graph) -> Graph:
    return Graph(g.vertices, reverse(g.edges), g.directed)


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").agg(F.count("*").alias("loops"))


def with_self_loops(edges: DataFrame, vertices: DataFrame, weight: int = 1, where: Column | None = None) -> DataFrame:
    """A loop of the weight at each vertex for which `where` holds, beside the edges."""
    chosen = vertices.where(where) if where is not None else vertices
    loops = chosen.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(weight).cast("long").alias("weight"))
    have = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1).cast("long"))
    return have.where("src <> dst").unionByName(loops)


def subgraph(g: Graph, vertex: Column | None = None, edge: Column | None = None) -> Graph:
    """The vertices and edges that the predicates (over id; over src, dst, weight) accept."""
    ids = g.vertices.where(vertex) if vertex is not None else g.vertices
    kept = g.edges.where(edge) if edge is not None else g.edges
    if vertex is not None:
        kept = kept.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(ids, kept.select(g.edges.columns), g.directed)


def induced(g: Graph, membership: DataFrame) -> DataFrame:
    """(community, src, dst, weight) of the edges inside communities, with ids local to each."""
    local = membership.withColumn("local", F.row_number().over(Window.partitionBy("community").orderBy("id")) - 1)
    a = local.select(F.col("id").alias("src"), F.col("community"), F.col("local").alias("ls"))
    b = local.select(F.col("id").alias("dst"), F.col("community").alias("cd"), F.col("local").alias("ld"))
    both = g.edges.join(a, "src").join(b, "dst").where("community = cd")
    return both.select("community", F.col("ls").cast("long").alias("src"), F.col("ld").cast("long").alias("dst"), "weight")


def relabelled(g: Graph, mapping: DataFrame) -> Graph:
    """The graph under (old_id, new_id); weights stay."""
    a = mapping.select(F.col("old_id").alias("src"), F.col("new_id").alias("__s"))
    b = mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("__d"))
    e = g.edges.join(a, "src").join(b, "dst")
    rest = [c for c in g.edges.columns if c not in ("src", "dst")]
    ids = g.vertices.join(mapping.withColumnRenamed("old_id", "id"), "id").select(F.col("new_id").alias("id"))
    return Graph(ids, e.select(F.col("__s").alias("src"), F.col("__d").alias("dst"), *rest), g.directed)


def composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """The permutation that applies `first` and then `then`, by (old_id, new_id)."""
    inner = then.select(F.col("old_id").alias("__m"), F.col("new_id").alias("__n"))
    return first.join(inner, F.col("new_id") == F.col("__m")).select("old_id", F.col("__n").alias("new_id"))


def weakly_flat(g: Graph) -> DataFrame:
    """Out- and in-edges as one multiset with weight 1."""
    one = g.edges.select("src", "dst", F.lit(1).cast("long").alias("weight"))
    return one.unionByName(reverse(one))


def flat(g: Graph, incoming: bool = False) -> DataFrame:
    return reverse(g.edges) if incoming else g.edges


def oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, from the smaller id."""
    return edges.where("src < dst")


def applied_batch(g: Graph, deletions: DataFrame | None = None, insertions: DataFrame | None = None) -> Graph:
    """Deletions by (src, dst), then insertions; both are tidied, and both directions are meant in
    an undirected graph. An inserted edge that exists takes the inserted weight."""
    both = (lambda df: df) if g.directed else (lambda df: df.unionByName(reverse(df)))
    edges, ids = g.edges, g.vertices
    if deletions is not None:
        edges = edges.join(both(deletions.select("src", "dst")).distinct(), ["src", "dst"], "left_anti")
    if insertions is not None:
        new = Graph.from_edges(insertions, g.directed)
        edges = edges.join(new.edges, ["src", "dst"], "left_anti").unionByName(new.edges)
        ids = ids.union(new.vertices).distinct()
    return Graph(ids, edges.select("src", "dst", "weight"), g.directed)


def without_vertices(g: Graph, ids: DataFrame) -> Graph:
    kept = g.vertices.join(ids.select("id"), "id", "left_anti")
    e = g.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return Graph(kept, e.select(g.edges.columns), g.directed)


def random_deletions(g: Graph, n: int, seed: int = 0) -> DataFrame:
    """n edges by the least hashes: the same for a seed, however rows are dealt."""
    return g.edges.orderBy(F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst").limit(n).select("src", "dst", "weight")


def random_insertions(g: Graph, n: int, size: int, seed: int = 0) -> DataFrame:
    """n pairs of ids below `size`, drawn by hash; loops are left out."""
    pick = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(size))
    drawn = g.edges.sparkSession.range(n).select(pick(1).alias("src"), pick(2).alias("dst"), F.lit(1).cast("long").alias("weight"))
    return drawn.where("src <> dst")


def slices(g: Graph, n: int, p_n: int) -> DataFrame:
    """Edges with the slice of their destination: p_n ranges of ids, the remainder in the first."""
    small, extra = divmod(n, p_n)
    edge = extra * (small + 1)
    late = F.floor((F.col("dst") - edge) / F.lit(max(1, small))) + extra
    return g.edges.withColumn("slice", F.when(F.col("dst") < edge, F.floor(F.col("dst") / (small + 1))).otherwise(late).cast("long"))


def slice_of(g: Graph, start: int, stop: int) -> DataFrame:
    return g.edges.where((F.col("dst") >= start) & (F.col("dst") < stop))


def tiles(g: Graph, width: int) -> DataFrame:
    """(src, tile): each neighbour's tile."""
    return g.edges.select("src", F.floor(F.col("dst") / width).alias("tile"))


def degree_classes(g: Graph) -> DataFrame:
    """(id, degree, class): 0 for over 100, 1 for 2 to 100, 2 for less; out-degrees."""
    d = degrees(g)
    kind = F.when(F.col("out_degree") > 100, 0).when(F.col("out_degree") >= 2, 1).otherwise(2)
    return d.select("id", F.col("out_degree").alias("degree"), kind.cast("long").alias("class"))


def degree_oriented(g: Graph) -> DataFrame:
    """Each undirected edge once, from the end of the lower (degree, id)."""
    d = degrees(g).select("id", F.col("out_degree").alias("d"))
    e = g.edges.where("src < dst").select("src", "dst")
    e = e.join(d.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def tiled_partition(g: Graph, p_n: int, p_m: int) -> DataFrame:
    """Edges oriented by degree, renumbered by (class, degree descending, id), with their tile of p_n by p_m."""
    order = numbered(degree_classes(g), F.col("class"), F.desc("degree"), F.col("id"), name="rank").select("id", "rank")
    e = degree_oriented(g)
    e = e.join(order.select(F.col("id").alias("src"), F.col("rank").alias("rs")), "src").join(order.select(F.col("id").alias("dst"), F.col("rank").alias("rd")), "dst")
    return e.select(F.col("rs").alias("src"), F.col("rd").alias("dst"), (F.pmod("rs", F.lit(p_n)) * p_m + F.pmod("rd", F.lit(p_m))).alias("tile"))


def is_bijection(mapping: DataFrame) -> DataFrame:
    """(n, is_bijection): whether new ids are 0..n-1 and both columns distinct."""
    row = mapping.agg(F.count("*").alias("n"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi"), F.count_distinct("new_id").alias("d"), F.count_distinct("old_id").alias("o"))
    good = (F.col("n") == 0) | ((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n")) & (F.col("o") == F.col("n")))
    return row.select("n", good.alias("is_bijection"))
