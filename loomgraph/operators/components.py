"""Connected components as alternating large-star and small-star rounds.

Each round is two joins-free aggregations over the edges; edges only ever move
towards smaller ids, so the label of a component is its smallest vertex id. The
edge table shrinks to one star a component in a logarithmic number of rounds.

Before the rounds, tasks of at most LOCAL edges each replace their edges by one star a
component of what they hold, which keeps all components. Where one task holds all edges
that is the result already; else the rounds begin with far fewer edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.runtime import by_value, release
from loomgraph.runtime import cut_flat as cut

#: Edges that a task contracts by itself.
LOCAL = 250_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, least vertex of its component) of the edges, without the least ones themselves."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: u.size], at[u.size :]
    label = np.arange(ids.size)
    while a.size:
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # x and y are roots: the greater is hung below the smaller, then all point to roots again
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(ids.size))
    return ids[moved], ids[label[moved]]


def _contracted(edges: DataFrame, whole: bool = False) -> DataFrame:
    """edges(u, v) of longs with those of each LOCAL or so of a partition replaced by stars; with `whole`, for
    edges in one partition, each star's centre has a row with itself, too."""

    def contract(held: list) -> pa.RecordBatch:
        found = pa.Table.from_batches(held)
        u, v = stars(found["u"].to_numpy(), found["v"].to_numpy())
        if whole:
            u, v = np.concatenate([u, np.unique(v)]), np.concatenate([v, np.unique(v)])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= LOCAL and not whole:
                yield contract(held)
                held, n = [], 0
        if held:
            yield contract(held)

    return edges.mapInArrow(run, "u long, v long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v): large-star points the greater neighbours of each vertex at the least
    of its neighbourhood, small-star the smaller ones and the vertex itself."""
    if large:
        around = edges.union(edges.select("v", "u"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 50, local: int = LOCAL) -> DataFrame:
    """(id, component) of every vertex with an edge to another; component = smallest id.

    Loops and null ends are ignored. Directed edges count as undirected.
    """
    now = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mark = None
    if all(f.dataType == T.LongType() for f in now.schema):
        now = cut(_contracted(now))  # so that few of very many edges are moved at all
        parts = max(1, -(-now.count() // local))
        alone = parts == 1
        now, before = cut(_contracted(now.coalesce(1) if alone else now.repartition(parts), alone)), now
        release(before)
        if alone:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    else:
        now = cut(now.distinct())
    for _ in range(max_rounds):
        now, before = cut(_star(_star(now, True), False)), now
        release(before)
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (seen["n"], seen["x"]) == mark:
            return _labels(now)
        mark = (seen["n"], seen["x"])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _labels(settled: DataFrame) -> DataFrame:
    """Of edges that join every vertex (u) with its component's least (v), a row for each vertex."""
    return settled.select(F.col("u").alias("id"), F.col("v").alias("component")).union(settled.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


by_value(__name__)
