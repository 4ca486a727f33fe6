"""Gather-apply-scatter supersteps: programs are column builders, the loop is shared."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.runtime import cut_flat as cut
from loomgraph.runtime import laid_out, release


class VertexProgram(Protocol):
    """State is the column `state`; `active` marks vertices whose out-edges are gathered."""

    dense: bool

    def start(self, g: Graph) -> DataFrame: ...
    def gather(self, state: Column, edge: dict[str, Column]) -> Column: ...
    def combine(self, value: Column) -> Column: ...
    def apply(self, state: Column, gathered: Column) -> Column: ...
    def active(self, old: Column, new: Column) -> Column: ...
    def converged(self, rows: DataFrame) -> bool: ...


@dataclass(frozen=True)
class Superstep:
    number: int
    active: int
    edges: int


def run(g: Graph, program: VertexProgram, max_steps: int = 100) -> tuple[DataFrame, list[Superstep]]:
    """(id, state) and what each superstep did. A dense program gathers over all edges; another only
    from vertices whose state changed, and raises if some still change after max_steps; a dense one
    ends there. Both states of a step are tables, so none is overwritten."""
    out = g.edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    edges = laid_out(g.edges.join(out, "src"))
    degree = cut(out.withColumnRenamed("src", "id"))
    state = cut(program.start(g).join(degree, "id", "left").withColumn("active", F.lit(True)))
    work = F.struct(F.count_if("active").alias("moved"), F.coalesce(F.sum(F.when(F.lit(program.dense) | F.col("active"), F.col("out_degree"))), F.lit(0)).alias("edges"))
    reads = state.agg(work.alias("w")).first()["w"]["edges"]
    log: list[Superstep] = []
    for step in range(1, max_steps + 1):
        senders = state if program.dense else state.where("active")
        e = edges.join(senders.select(F.col("id").alias("src"), F.col("state").alias("s")), "src")
        near = e.groupBy(F.col("dst").alias("id")).agg(program.combine(program.gather(F.col("s"), {c: F.col(c) for c in ("src", "dst", "weight", "out_degree")})).alias("g"))
        rows = state.select("id", "state", "out_degree").join(near, "id", "left").select("id", "out_degree", F.col("state").alias("old"), program.apply(F.col("state"), F.col("g")).alias("state"))
        rows = cut(rows.withColumn("active", F.coalesce(program.active(F.col("old"), F.col("state")), F.lit(False))))
        now = rows.agg(work.alias("w")).first()["w"]
        log.append(Superstep(step, now["moved"], reads))
        release(state)
        state, reads = rows, now["edges"]
        if program.converged(rows) or (not program.dense and now["moved"] == 0):
            break
    else:
        if not program.dense:
            raise RuntimeError(f"not settled after {max_steps} supersteps: {log[-1].active if log else 'all'} vertices still change")
    return state.select("id", "state"), log


@dataclass(frozen=True)
class PageRankProgram:
    n: int
    damping: float = 0.85
    epsilon: float = 1e-4
    fixed_work: bool = False
    dense: bool = True

    def start(self, g: Graph) -> DataFrame:
        return g.vertices.select("id", F.lit(1.0 / max(1, self.n)).alias("state"))

    def gather(self, state: Column, edge: dict[str, Column]) -> Column:
        return state / edge["out_degree"]

    def combine(self, value: Column) -> Column:
        return F.sum(value)

    def apply(self, state: Column, gathered: Column) -> Column:
        return F.lit((1 - self.damping) / max(1, self.n)) + self.damping * F.coalesce(gathered, F.lit(0.0))

    def active(self, old: Column, new: Column) -> Column:
        return F.abs(new - old) > 0

    def converged(self, rows: DataFrame) -> bool:
        return not self.fixed_work and (rows.agg(F.sum(F.abs(F.col("state") - F.col("old")))).first()[0] or 0.0) < self.epsilon


class _Least:
    dense = False

    def combine(self, value: Column) -> Column:
        return F.min(value)

    def apply(self, state: Column, gathered: Column) -> Column:
        return F.least(state, gathered)

    def active(self, old: Column, new: Column) -> Column:
        return new.isNotNull() & (old.isNull() | (new < old))

    def converged(self, rows: DataFrame) -> bool:
        return False


class ComponentProgram(_Least):
    """Least id of the weak component; run it on a graph with both directions."""

    def start(self, g: Graph) -> DataFrame:
        return g.vertices.select("id", F.col("id").alias("state"))

    def gather(self, state: Column, edge: dict[str, Column]) -> Column:
        return state


@dataclass(frozen=True)
class DistanceProgram(_Least):
    source: int

    def start(self, g: Graph) -> DataFrame:
        return g.vertices.select("id", F.when(F.col("id") == self.source, F.lit(0).cast("long")).alias("state"))

    def gather(self, state: Column, edge: dict[str, Column]) -> Column:
        return state + edge["weight"]


def pagerank(g: Graph, max_iters: int = 20, epsilon: float = 1e-4, fixed_work: bool = False) -> DataFrame:
    n = g.vertices.count()
    return run(g, PageRankProgram(n, epsilon=epsilon, fixed_work=fixed_work), max_iters)[0].withColumnRenamed("state", "score")


def components(g: Graph) -> DataFrame:
    from loomgraph.operators.construct import weakly_flat

    both = Graph(g.vertices, weakly_flat(g), False)
    return run(both, ComponentProgram(), max_steps=10_000)[0].withColumnRenamed("state", "component")


def sssp(g: Graph, source: int) -> DataFrame:
    return run(g, DistanceProgram(source), max_steps=10_000)[0].where("state is not null").withColumnRenamed("state", "dist")
