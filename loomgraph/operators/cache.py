"""Replays of memory traces through set-associative caches.

A set's accesses do not depend on other sets', so a level is replayed set by set in
parallel. The misses of a level, in their order, are the trace of the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.construct import offsets
from loomgraph.runtime import by_value

POLICIES = ("lru", "fifo", "random", "lfu", "plru", "srrip", "grasp", "popt")
LFU_HALVING = 1024
FAR, LONG = 3, 2


@dataclass(frozen=True)
class Level:
    name: str
    size: int
    ways: int
    line: int = 64
    policy: str = "lru"

    @property
    def sets(self) -> int:
        return max(1, self.size // (self.line * self.ways))


def gather_trace(g: Graph, property_bytes: int = 4, base: int = 0) -> DataFrame:
    """(at, address, hot): the property reads of a pull sweep: per vertex in id order its neighbours' values.
    hot: the line belongs to the upper tenth of degrees when ids are a degree order."""
    starts = offsets(g).withColumnRenamed("id", "src")
    n = g.vertices.count()
    e = g.edges.select("src", "dst").withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
    return e.join(starts, "src").select((F.col("start") + F.col("i")).alias("at"), (F.col("dst") * property_bytes + base).alias("address"), (F.col("dst") < n // 10).alias("hot"))


def with_next_use(trace: DataFrame, line: int = 64) -> DataFrame:
    """The trace with the place of the line's next access: what an optimal policy looks at."""
    w = Window.partitionBy(F.floor(F.col("address") / line)).orderBy("at")
    return trace.withColumn("next", F.lead("at").over(w))


def _victim(policy: str, lines: dict[int, list], rng: list[int]) -> int:
    """lines: tag -> [last use, entry, uses, rrpv, next use]."""
    if policy == "fifo":
        return min(lines, key=lambda t: lines[t][1])
    if policy == "random":
        rng[0] = (rng[0] * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
        return sorted(lines, key=lambda t: lines[t][1])[(rng[0] >> 33) % len(lines)]
    if policy == "lfu":
        return min(lines, key=lambda t: (lines[t][2], lines[t][0]))
    if policy in ("srrip", "grasp"):
        most = max(x[3] for x in lines.values())
        for x in lines.values():
            x[3] += FAR - most
        return min((t for t in lines if lines[t][3] == FAR), key=lambda t: lines[t][1])
    if policy == "popt":
        return max(lines, key=lambda t: (lines[t][4], -lines[t][0]))
    return min(lines, key=lambda t: lines[t][0])  # lru, and plru, which is taken as lru


def replay_set(at: list[int], tags: list[int], ways: int, policy: str, hot: list[bool] | None = None, nxt: list | None = None) -> list[bool]:
    """Whether each access of one set hits."""
    lines: dict[int, list] = {}
    rng, evicted, out = [42], 0, []
    for k, (a, t) in enumerate(zip(at, tags)):
        use = nxt[k] if nxt is not None and nxt[k] == nxt[k] and nxt[k] is not None else 1 << 62
        x = lines.get(t)
        out.append(x is not None)
        if x is not None:
            x[0], x[2], x[3], x[4] = a, x[2] + 1, 0, use
            continue
        if len(lines) >= ways:
            del lines[_victim(policy, lines, rng)]
            evicted += 1
            if policy == "lfu" and evicted % LFU_HALVING == 0:
                for y in lines.values():
                    y[2] //= 2
        near = policy == "grasp" and hot is not None and hot[k]
        lines[t] = [a, a, 1, 0 if near else LONG, use]
    return out


def replay(trace: DataFrame, level: Level) -> DataFrame:
    """trace (at, address[, hot, next]) -> with `hit`."""
    if level.policy not in POLICIES:
        raise ValueError(f"unknown policy {level.policy!r}")
    rows = with_next_use(trace, level.line) if level.policy == "popt" else trace
    block = F.floor(F.col("address") / level.line)
    rows = rows.withColumns({"__set": F.pmod(block, F.lit(level.sets)), "__tag": F.floor(block / level.sets)})
    ways, policy = level.ways, level.policy

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        hits = replay_set(pdf["at"].tolist(), pdf["__tag"].tolist(), ways, policy, pdf["hot"].tolist() if "hot" in pdf else None, pdf["next"].tolist() if "next" in pdf else None)
        return pdf.assign(hit=hits)[["at", "address", *(["hot"] if "hot" in pdf else []), "hit"]]

    schema = "at long, address long, " + ("hot boolean, " if "hot" in trace.columns else "") + "hit boolean"
    return rows.groupBy("__set").applyInPandas(run, schema)


def hierarchy(trace: DataFrame, levels: list[Level]) -> DataFrame:
    """(level, name, accesses, hits, misses, miss_rate): misses go on to the next level; those of the last are memory's."""
    out, now = None, trace
    for k, level in enumerate(levels):
        done = replay(now, level)
        row = done.agg(F.count("*").alias("accesses"), F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"))
        row = row.select(F.lit(k + 1).alias("level"), F.lit(level.name).alias("name"), "accesses", "hits", (F.col("accesses") - F.col("hits")).alias("misses"))
        out = row if out is None else out.union(row)
        now = done.where(~F.col("hit")).drop("hit")
    return out.withColumn("miss_rate", F.when(F.col("accesses") > 0, F.col("misses") / F.col("accesses")).otherwise(0.0))


def reuse_gaps(trace: DataFrame, line: int = 64) -> DataFrame:
    """(gap, n): accesses between two of one line."""
    w = Window.partitionBy(F.floor(F.col("address") / line)).orderBy("at")
    gap = F.col("at") - F.lag("at").over(w)
    return trace.select(gap.alias("gap")).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


def epochs(trace: DataFrame, length: int, line: int = 64) -> DataFrame:
    """(line, epoch, next_epoch): in which epoch of the sweep a line is used next after each epoch it is used in."""
    used = trace.select(F.floor(F.col("address") / line).alias("line"), F.floor(F.col("at") / length).alias("epoch")).distinct()
    return used.withColumn("next_epoch", F.lead("epoch").over(Window.partitionBy("line").orderBy("epoch")))


by_value(__name__)
