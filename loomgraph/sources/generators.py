"""Synthetic graphs as column expressions over spark.range: (src, dst), src < dst but for
the random ones. No edge is made on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ordered(df: DataFrame) -> DataFrame:
    return df.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def kronecker(spark: SparkSession, scale: int, degree: int = 16, seed: int = 27491095) -> DataFrame:
    """2^scale vertices and degree * 2^scale draws: at each of `scale` levels an edge goes to a quarter of
    the matrix with chances 0.57, 0.19, 0.19, 0.05, decided by a hash."""
    edge = spark.range(degree << scale)
    src = dst = F.lit(0).cast("long")
    for level in range(scale):
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "id"), F.lit(10_000))
        src = F.shiftleft(src, 1) + F.when(u >= 7600, 1).otherwise(0)
        dst = F.shiftleft(dst, 1) + F.when(((u >= 5700) & (u < 7600)) | (u >= 9500), 1).otherwise(0)
    return edge.select(src.alias("src"), dst.alias("dst"))


def uniform(spark: SparkSession, scale: int, degree: int = 16, seed: int = 27491095) -> DataFrame:
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "id").bitwiseAND(F.lit((1 << scale) - 1))
    return spark.range(degree << scale).select(draw(0).alias("src"), draw(1).alias("dst"))


def chain(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))


def grid(spark: SparkSession, n: int) -> DataFrame:
    side = math.isqrt(n)
    if side * side != n:
        raise ValueError("a grid's size is a square")
    v = spark.range(n)
    right = v.where(F.col("id") % side < side - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return right.union(v.where(F.col("id") < n - side).select("id", F.col("id") + side))


def hub_spoke(spark: SparkSession, n: int, group: int = 32) -> DataFrame:
    """Groups of a hub and its leaves; the hubs in a ring."""
    v = spark.range(n).withColumn("hub", F.col("id") - F.col("id") % group)
    spokes = v.where("id <> hub").select(F.col("hub").alias("src"), F.col("id").alias("dst"))
    groups = -(-n // group)
    ring = v.where("id = hub").select("id", (F.pmod(F.col("id") / group + 1, F.lit(groups)) * group).cast("long").alias("o"))
    return spokes.union(_ordered(ring.toDF("src", "dst")))


def block_biclique(spark: SparkSession, n: int, block: int = 32) -> DataFrame:
    half = block // 2
    left = spark.range(n).where(F.col("id") % block < half)
    start = F.col("id") - F.col("id") % block
    pairs = left.select(F.col("id").alias("src"), F.explode(F.sequence(start + half, start + block - 1)).alias("dst"))
    return pairs.where(F.col("dst") < n)


def copied_neighborhood(spark: SparkSession, n: int, block: int = 64, anchors: int = 8, copied: int = 6) -> DataFrame:
    """Blocks of anchors in a ring and copies that all have the same first anchors as neighbours."""
    v = spark.range(n).withColumn("start", F.col("id") - F.col("id") % block).withColumn("k", F.col("id") % block)
    held = F.least(F.lit(anchors), F.lit(n) - F.col("start"))
    ring = v.where(F.col("k") < anchors).select(F.col("id").alias("src"), (F.col("start") + F.pmod(F.col("k") + 1, held)).alias("dst"))
    copies = v.where(F.col("k") >= anchors).select(F.explode(F.sequence(F.col("start"), F.col("start") + min(copied, anchors) - 1)).alias("src"), F.col("id").alias("dst"))
    return _ordered(ring).union(copies)


def community_bridge(spark: SparkSession, n: int, block: int = 64, offsets: tuple[int, ...] = (1, 2, 3), width: int = 2) -> DataFrame:
    """Rings with several offsets, neighbouring rings joined by `width` edges."""
    v = spark.range(n).withColumn("start", F.col("id") - F.col("id") % block)
    size = F.least(F.lit(block), F.lit(n) - F.col("start"))
    rings = v.select(F.col("id").alias("src"), F.explode(F.array(*(F.col("start") + F.pmod(F.col("id") - F.col("start") + o, size) for o in offsets))).alias("dst"))
    last = ((n - 1) // block) * block if n else 0
    ends = v.where((F.col("id") == F.col("start")) & (F.col("id") < last))
    pick: list[Column] = [F.struct(F.least(F.col("id") + k, F.lit(n - 1)).alias("src"), F.least(F.col("id") + block + k, F.lit(n - 1)).alias("dst")) for k in range(width)]
    bridges = ends.select(F.explode(F.array(*pick)).alias("e")).select("e.*")
    return _ordered(rings.union(bridges))


def expander(spark: SparkSession, n: int, degree: int = 8, seed: int = 0) -> DataFrame:
    """A circulant graph of degree / 2 offsets, drawn by a hash without repeats."""
    available = n // 2 - 1
    if degree <= 0 or degree % 2 or available < degree // 2:
        raise ValueError("the degree is positive and even, and the graph large enough for it")
    drawn = spark.range(64 * degree).select((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(available)) + 1).alias("o"), "id")
    few = drawn.groupBy("o").agg(F.min("id").alias("first")).orderBy("first").limit(degree // 2)
    v = spark.range(n)
    offsets = [r["o"] for r in few.collect()]
    return _ordered(v.select(F.col("id").alias("src"), F.explode(F.array(*(F.pmod(F.col("id") + o, F.lit(n)) for o in offsets))).alias("dst")))


def shuffled(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The edges under random labels 0..n-1."""
    from loomgraph.graph import numbered

    spark = edges.sparkSession
    order = numbered(spark.range(n), F.xxhash64(F.lit(seed), "id"), F.col("id"))
    a, b = order.select(F.col("id").alias("src"), F.col("new_id").alias("s")), order.select(F.col("id").alias("dst"), F.col("new_id").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))


FAMILIES = {
    "chain": chain, "grid": grid, "hub-spoke": hub_spoke, "block-biclique": block_biclique,
    "copied-neighborhood": copied_neighborhood, "community-bridge": community_bridge, "expander-control": expander,
}
