"""The graph as two DataFrames: edges (src, dst[, weight]) and vertices (id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import cut, cut_flat, partitions


@dataclass(frozen=True)
class Graph:
    """vertices: id LONG, distinct. edges: src, dst LONG and weight LONG; an undirected
    graph holds both directions of each edge once."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    @classmethod
    def from_edges(cls, edges: DataFrame, directed: bool = True, vertices: DataFrame | None = None) -> Graph:
        """Rows with a null end are left out; a missing weight is 1; loops and repeats go
        (the least weight stays); undirected: reverses are added."""
        weight = F.coalesce(F.col("weight").cast("long"), F.lit(1)) if "weight" in edges.columns else F.lit(1).cast("long")
        rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"))
        rows = rows.where("src is not null and dst is not null")
        ends = vertices.select("id") if vertices is not None else rows.select(F.explode(F.array("src", "dst")).alias("id"))
        rows = rows.where("src <> dst")
        if not directed:
            rows = rows.unionByName(reverse(rows))
        return cls(ends.distinct(), rows.groupBy("src", "dst").agg(F.min("weight").alias("weight")), directed)

    @classmethod
    def dense(cls, edges: DataFrame, directed: bool = True) -> Graph:
        """As from_edges, with all ids from 0 to the greatest as vertices."""
        n = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        ids = edges.sparkSession.range(0 if n is None else n + 1)
        return cls.from_edges(edges, directed, ids)

    def cut(self) -> Graph:
        """The same graph, materialised in the checkpoint folder, edges dealt by src."""
        n = partitions(self.edges.sparkSession)
        return Graph(cut(self.vertices), cut(self.edges.repartition(n, "src")), self.directed)

    def flat(self) -> Graph:
        """An undirected graph as tables that take little disk: each edge is written once and read both ways."""
        if self.directed:
            return Graph(cut_flat(self.vertices), cut_flat(self.edges), True)
        half = cut_flat(self.edges.where("src < dst"))
        return Graph(cut_flat(self.vertices), half.unionByName(reverse(half)), False)


def reverse(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def numbered(df: DataFrame, *order: Column | str, name: str = "new_id") -> DataFrame:
    """df with the row's place (from 0) in the total order: ranges of near equal size are
    sorted side by side, and the ranges' counts, a number a partition, give the offsets.
    No task sees all rows."""
    spark = df.sparkSession
    n = partitions(spark)
    laid = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order))
    at = laid.withColumn("__m", F.monotonically_increasing_id())
    at = at.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))})
    before, offsets = 0, []
    for r in sorted(at.groupBy("__p").count().collect()):
        offsets.append((r[0], before))
        before += r[1]
    held = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "__p long, __o long"))
    return at.join(held, "__p").withColumn(name, F.col("__o") + F.col("__i")).drop("__m", "__p", "__i", "__o")
