"""Vertex partitions, their shards, ghosts and traffic."""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.construct import degrees
from loomgraph.runtime import cut


def vertex_weights(g: Graph, by: str = "total") -> DataFrame:
    """(id, w): 1 a vertex, or its out- or total edges."""
    d = degrees(g)
    w = {"vertices": F.lit(1).cast("long"), "out": F.col("out_degree"), "total": F.col("out_degree") + F.col("in_degree")}[by]
    return d.select("id", w.alias("w"))


def prefix_sums(weights: DataFrame, block: int = 65_536) -> DataFrame:
    """(id, w, upto): inclusive sums in id order, in two levels."""
    d = weights.withColumn("b", F.floor(F.col("id") / block))
    blocks = d.groupBy("b").agg(F.sum("w").alias("s"))
    before = blocks.select("b", (F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"))
    within = F.sum("w").over(Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("within", within).join(before, "b").select("id", "w", (F.col("before") + F.col("within")).alias("upto"))


def balanced_ranges(g: Graph, shards: int, by: str = "total") -> DataFrame:
    """(shard, first, end) of contiguous ids 0..n-1: each cut is where the prefix sum is nearest the
    target (ties: the earlier place), moved so that no shard is empty."""
    n = g.vertices.count()
    sums = cut(prefix_sums(vertex_weights(g, by)))
    total = sums.agg(F.max("upto")).first()[0] or 0
    rows, first = [], 0
    targets = [total * s / shards for s in range(1, shards)]
    best: dict[int, int] = {}
    if targets:
        t = sums.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(targets)], "t int, target double")
        # the two places around a target: the last at or below it, and the next
        near = sums.join(F.broadcast(t), F.abs(F.col("upto") - F.col("target")) <= F.col("w"))
        picked = near.groupBy("t").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("target")).alias("d"), "id")).alias("b"))
        best = {r["t"]: r["b"]["id"] + 1 for r in picked.collect()}
    for s in range(shards):
        end = n if s == shards - 1 else min(max(best.get(s, first + 1), first + 1), n - (shards - 1 - s))
        rows.append((s, first, max(first, end)))
        first = max(first, end)
    return g.vertices.sparkSession.createDataFrame(rows, "shard long, first long, end long")


def range_owners(g: Graph, ranges: DataFrame) -> DataFrame:
    """(id, owner): a row a shard travels to all tasks."""
    return g.vertices.join(F.broadcast(ranges), (F.col("id") >= F.col("first")) & (F.col("id") < F.col("end"))).select("id", F.col("shard").alias("owner"))


def community_owners(g: Graph, membership: DataFrame, shards: int, by: str = "total") -> DataFrame:
    """(id, owner): whole communities, heaviest first (ties: the smaller id), each to the shard with
    least weight (ties: the smaller shard). Communities' weights, not vertices, go to the driver."""
    w = membership.join(vertex_weights(g, by), "id").groupBy("community").agg(F.sum("w").alias("w"))
    heap = [(0, s) for s in range(shards)]
    owner = []
    for r in w.orderBy(F.desc("w"), "community").collect():
        load, s = heapq.heappop(heap)
        owner.append((r["community"], s))
        heapq.heappush(heap, (load + r["w"], s))
    table = g.vertices.sparkSession.createDataFrame(owner, "community long, owner long")
    return membership.join(table, "community").select("id", "owner")


def contiguous_after(g: Graph, mapping: DataFrame, shards: int, by: str = "total") -> DataFrame:
    """(id, owner) of balanced ranges over the places of a permutation."""
    w = vertex_weights(g, by).join(mapping.withColumnRenamed("old_id", "id"), "id")
    total = w.agg(F.sum("w")).first()[0] or 1
    sums = prefix_sums(w.select(F.col("new_id").alias("id"), "w"))
    own = sums.select(F.col("id").alias("new_id"), F.least(F.floor((F.col("upto") - F.col("w") / 2.0) * shards / total), F.lit(shards - 1)).cast("long").alias("owner"))
    return mapping.join(own, "new_id").select(F.col("old_id").alias("id"), "owner")


def _crossing(g: Graph, owners: DataFrame) -> DataFrame:
    a = owners.select(F.col("id").alias("src"), F.col("owner").alias("os"))
    b = owners.select(F.col("id").alias("dst"), F.col("owner").alias("od"))
    return g.edges.select("src", "dst").join(a, "src").join(b, "dst")


def ghosts(g: Graph, owners: DataFrame) -> DataFrame:
    """(shard, ghost): remote vertices that a shard's vertices touch, by out- and in-edges."""
    e = _crossing(g, owners).where("os <> od")
    return e.select(F.col("os").alias("shard"), F.col("dst").alias("ghost")).union(e.select("od", "src")).distinct()


def ownership(g: Graph, owners: DataFrame, explicit: bool = True) -> DataFrame:
    """A row a shard: owned, out and in edges, remote ones, ghosts and bytes.

    bytes = 8 (owned + 1) + 4 out, the same for in-edges if directed, 8 a ghost, and 4
    a vertex where owners are an explicit map. Undirected: remote_in is remote_out.
    """
    e = _crossing(g, owners)
    far = F.when(F.col("os") != F.col("od"), 1).otherwise(0)
    out = e.groupBy(F.col("os").alias("shard")).agg(F.count("*").alias("out_edges"), F.sum(far).alias("remote_out"))
    into = e.groupBy(F.col("od").alias("shard")).agg(F.count("*").alias("in_edges"), F.sum(far).alias("remote_in"))
    g_ = ghosts(g, owners).groupBy("shard").agg(F.count("*").alias("ghosts"))
    base = owners.groupBy(F.col("owner").alias("shard")).agg(F.count("*").alias("owned"))
    rows = base.join(out, "shard", "left").join(into, "shard", "left").join(g_, "shard", "left").na.fill(0)
    if not g.directed:
        rows = rows.withColumns({"in_edges": F.col("out_edges"), "remote_in": F.col("remote_out")})
    size = 8 * (F.col("owned") + 1) + 4 * F.col("out_edges") + 8 * F.col("ghosts") + (4 * F.col("owned") if explicit else F.lit(0))
    if g.directed:
        size = size + 8 * (F.col("owned") + 1) + 4 * F.col("in_edges")
    return rows.select("shard", "owned", "out_edges", "in_edges", "remote_out", "remote_in", "ghosts", size.alias("bytes"))


def ownership_summary(per_shard: DataFrame) -> DataFrame:
    """(remote_fraction, ghosts, imbalance, bytes); imbalance = most over mean of out-edges, 1 if there are none."""
    s = per_shard.agg(F.sum("remote_out").alias("r"), F.sum("out_edges").alias("e"), F.sum("ghosts").alias("ghosts"), F.max("out_edges").alias("m"), F.avg("out_edges").alias("a"), F.sum("bytes").alias("bytes"))
    safe = lambda x, y, z: F.when(y > 0, x / y).otherwise(F.lit(z))
    return s.select(safe(F.col("r"), F.col("e"), 0.0).alias("remote_fraction"), "ghosts", safe(F.col("m"), F.col("a"), 1.0).alias("imbalance"), "bytes")


def halo_bytes(g: Graph, owners: DataFrame, property_bytes: int = 8) -> DataFrame:
    """(owner, shard, values, bytes): what each owner sends each other shard in a superstep that
    refreshes all ghosts."""
    held = ghosts(g, owners).join(owners.select(F.col("id").alias("ghost"), "owner"), "ghost")
    return held.groupBy("owner", "shard").agg(F.count("*").alias("values"), (F.count("*") * property_bytes).alias("bytes"))


def fingerprint(g: Graph) -> DataFrame:
    """(vertices, edges, topology): a digest of the edges that does not depend on their order."""
    e = g.edges.agg(F.count("*").alias("edges"), F.coalesce(F.bit_xor(F.xxhash64("src", "dst", "weight")), F.lit(0)).alias("topology"))
    return e.withColumn("vertices", F.lit(g.vertices.count()).cast("long")).select("vertices", "edges", "topology")


FORMAT = "loom.shards.v1"


def export_shards(g: Graph, owners: DataFrame, path: str, mapping: DataFrame | None = None) -> dict:
    """Writes edges, vertices and ghosts by shard, the mapping, and a manifest with counts and
    digests, as Parquet that any executor writes its own part of."""
    spark = g.edges.sparkSession
    own = owners.select(F.col("id").alias("src"), F.col("owner").alias("shard"))
    g.edges.join(own, "src").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/edges")
    owners.select("id", F.col("owner").alias("shard")).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/vertices")
    ghosts(g, owners).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/ghosts")
    if mapping is not None:
        mapping.write.mode("overwrite").parquet(f"{path}/mapping")
    manifest = {"format": FORMAT, "directed": g.directed, "mapping": mapping is not None} | _facts(spark, path)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def _facts(spark: SparkSession, path: str) -> dict:
    e, v, h = (spark.read.parquet(f"{path}/{x}") for x in ("edges", "vertices", "ghosts"))
    of = lambda df, *c: df.groupBy("shard").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*c)).alias("x")).orderBy("shard").collect()
    held = {"edges": of(e, "src", "dst", "weight"), "vertices": of(v, "id"), "ghosts": of(h, "ghost")}
    return {k: {str(r["shard"]): [r["n"], r["x"]] for r in rows} for k, rows in held.items()}


def load_shards(spark: SparkSession, path: str, shard: int | None = None) -> tuple[Graph, DataFrame]:
    """The graph and its owners (id, owner), after counts and digests were checked."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("format") != FORMAT:
        raise ValueError(f"not a {FORMAT} package")
    facts = _facts(spark, path)
    if bad := [k for k in facts if facts[k] != manifest[k]]:
        raise ValueError(f"the package's {', '.join(bad)} differ from its manifest")
    e, v = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/vertices")
    if shard is not None:
        e, v = e.where(F.col("shard") == shard), v.where(F.col("shard") == shard)
    owners = v.select("id", F.col("shard").cast("long").alias("owner"))
    return Graph(owners.select("id"), e.select("src", "dst", "weight"), manifest["directed"]), owners
