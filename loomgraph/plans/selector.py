"""Choosing an ordering by deterministic rules over a feature row; no training, no trial runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.features import first_tier, working_set_ratio
from loomgraph.graph import Graph

#: The last-level cache that the published evidence implies; a parameter of every rule.
CACHE = 22 << 20
KERNELS = ("pr", "pr_spmv", "bfs", "cc", "cc_sv", "bc", "sssp")
#: The published plan of the low-reuse rule, and its thresholds below.
LOW_REUSE = "leiden:compose:sg_none:comm_size_desc:intra_gorder:gw8:cd_parallel:sgmb4096:gordf5000:norefine:2:2"
FALLBACK = "8:rabbit"


@dataclass(frozen=True)
class Choice:
    spec: str
    matched: bool
    reason: str


def low_reuse_matches(nodes: int, degree: float, cv: float, wsr: float, kernel: str, reuse: float) -> bool:
    even = cv <= 2.68 and (degree <= 60.0 or wsr <= 0.82)
    return kernel in KERNELS and reuse <= 2.0 and nodes >= 1000 and wsr <= 3.2 and (even or cv > 8.0)


def low_reuse_rule(nodes: int, degree: float, cv: float, wsr: float, kernel: str, reuse: float = 1.0) -> Choice:
    fits = low_reuse_matches(nodes, degree, cv, wsr, kernel, reuse)
    return Choice(LOW_REUSE if fits else FALLBACK, fits, "low reuse" if fits else "fallback")


def budgeted_rule(kernel: str, degree: float, cv: float, hub_share: float, reuse: float = 1.0) -> Choice:
    """PageRank once over a dense, even graph with hubs keeps its order's cheap composed form."""
    fits = kernel == "pr" and reuse <= 1.0 and degree >= 45 and cv < 3 and hub_share >= 0.3
    return Choice(LOW_REUSE if fits else FALLBACK, fits, "budget" if fits else "fallback")


def low_reuse_column(nodes: Column, degree: Column, cv: Column, wsr: Column, reuse: Column) -> Column:
    """The same rule over a table of feature rows."""
    even = (cv <= 2.68) & ((degree <= 60.0) | (wsr <= 0.82))
    return (reuse <= 2.0) & (nodes >= 1000) & (wsr <= 3.2) & (even | (cv > 8.0))


def options(text: str) -> dict[str, str]:
    """`policy:criterion:reuse`; anything unknown is refused."""
    parts = text.split(":")
    if parts[0] not in ("allkernel-lowreuse-rule", "budgeted-rule") or len(parts) > 3:
        raise ValueError(f"unknown policy {text!r}")
    criterion = parts[1] if len(parts) > 1 else "best-endtoend"
    reuse = parts[2] if len(parts) > 2 else "1"
    if criterion not in ("best-endtoend", "fastest-kernel") or not reuse.isdigit() or int(reuse) < 1:
        raise ValueError(f"unknown criterion or reuse in {text!r}")
    return {"policy": parts[0], "criterion": criterion, "reuse": reuse}


def choose(g: Graph, kernel: str, reuse: float = 1.0, cache_bytes: int = CACHE, policy: str = "allkernel-lowreuse-rule") -> Choice:
    row = first_tier(g).first()
    if policy == "budgeted-rule":
        return budgeted_rule(kernel, row["average_degree"], row["degree_cv"], row["hub_share"], reuse)
    wsr = working_set_ratio(kernel, row["nodes"], row["edges"], cache_bytes)
    return low_reuse_rule(row["nodes"], row["average_degree"], row["degree_cv"], wsr, kernel, reuse)


def perceptron(features: DataFrame, weights: dict[str, dict[str, float]], *by: str) -> DataFrame:
    """The arm of the greatest bias plus weighted features for each row, with its score and margin."""
    arms = [F.struct((F.lit(w.get("bias", 0.0)) + sum((F.coalesce(F.col(c), F.lit(0.0)) * x for c, x in w.items() if c != "bias"), F.lit(0.0))).alias("score"), F.lit(a).alias("arm")) for a, w in sorted(weights.items())]
    ranked = features.withColumn("__a", F.sort_array(F.array(*arms), asc=False))
    first, second = F.col("__a")[0], F.try_element_at("__a", F.lit(2))
    return ranked.select(*by, first["arm"].alias("arm"), first["score"].alias("score"), (first["score"] - second["score"]).alias("margin"))


def decision_tree(tree: dict) -> Column:
    """A tree {feature, threshold, left, right} with leaves {arm} as nested conditions."""
    if "arm" in tree:
        return F.lit(tree["arm"])
    return F.when(F.col(tree["feature"]) <= tree["threshold"], decision_tree(tree["left"])).otherwise(decision_tree(tree["right"]))


def nearest_arms(known: DataFrame, asked: DataFrame, features: list[str], k: int = 5) -> DataFrame:
    """(graph, arm): the arm most of the k nearest known graphs do best with; ties by the nearer. Both sides
    are a row a graph, and the known ones are sent in blocks to the asked."""
    gap = sum(((F.col(f"a.{f}") - F.col(f"b.{f}")) ** 2 for f in features), F.lit(0.0))
    pairs = asked.alias("a").join(F.broadcast(known.alias("b")), F.lit(True)).select(F.col("a.graph").alias("graph"), F.col("b.arm").alias("arm"), gap.alias("d"), F.col("b.graph").alias("other"))
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("graph").orderBy("d", "other"))).where(F.col("r") <= k)
    votes = near.groupBy("graph", "arm").agg(F.count("*").alias("n"), F.min("d").alias("d"))
    return votes.groupBy("graph").agg(F.min_by("arm", F.struct(-F.col("n"), "d", "arm")).alias("arm"))


def regret(results: DataFrame) -> DataFrame:
    """results (graph, benchmark, arm, time): each row's time over the best of its graph and benchmark, less one."""
    best = F.min("time").over(Window.partitionBy("graph", "benchmark"))
    return results.withColumn("regret", F.col("time") / best - 1)
