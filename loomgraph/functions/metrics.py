"""Layout, mapping and amortisation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalar import gap_bits
from loomgraph.graph import Graph

LINE = 8


def placed_edges(g: Graph, mapping: DataFrame) -> DataFrame:
    """(src, dst) under a permutation."""
    a = mapping.select(F.col("old_id").alias("src"), F.col("new_id").alias("s"))
    b = mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d"))
    return g.edges.select("src", "dst").join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def layout(g: Graph, mapping: DataFrame, line: int = LINE) -> DataFrame:
    """(edges, gap_mean, gap_p95, gap_max, log_bits, same_line, lines_per_row, row_span)."""
    e = placed_edges(g, mapping)
    gap = F.abs(F.col("src") - F.col("dst"))
    same = (F.floor(F.col("src") / line) == F.floor(F.col("dst") / line)).cast("double")
    over = e.agg(F.count("*").alias("edges"), F.avg(gap).alias("gap_mean"), F.percentile(gap, 0.95).alias("gap_p95"), F.max(gap).alias("gap_max"), F.avg(gap_bits(gap)).alias("log_bits"), F.avg(same).alias("same_line"))
    rows = e.groupBy("src").agg(F.count_distinct(F.floor(F.col("dst") / line)).alias("l"), (F.max("dst") - F.min("dst")).alias("w"))
    per = rows.agg(F.avg("l").alias("lines_per_row"), F.avg("w").alias("row_span"))
    return over.join(F.broadcast(per))


def neighbour_gaps(g: Graph, mapping: DataFrame) -> DataFrame:
    """(gaps, mean_gap, bits): gaps between neighbours that follow each other in a row, and their total bits."""
    from pyspark.sql import Window

    e = placed_edges(g, mapping)
    gap = F.col("dst") - F.lag("dst").over(Window.partitionBy("src").orderBy("dst"))
    rows = e.select(gap.alias("gap")).where("gap is not null")
    return rows.agg(F.count("*").alias("gaps"), F.avg("gap").alias("mean_gap"), F.sum(gap_bits(F.col("gap"))).alias("bits"))


def divergence(first: DataFrame, second: DataFrame) -> DataFrame:
    """(footrule, mirrored, displacement): mean |difference| of places over n, the lesser of it
    and that against the mirrored order, and the share of vertices in another place."""
    both = first.join(second.select("old_id", F.col("new_id").alias("other")), "old_id")
    n = F.count("*")
    gap, back = F.sum(F.abs(F.col("new_id") - F.col("other"))), F.lit(0)
    mirrored = both.join(F.broadcast(both.agg(F.max("other").alias("top"))))
    back = F.sum(F.abs(F.col("new_id") - (F.col("top") - F.col("other"))))
    rows = mirrored.agg(n.alias("n"), gap.alias("g"), back.alias("b"), F.sum((F.col("new_id") != F.col("other")).cast("long")).alias("m"))
    n2 = F.col("n").cast("double") * F.col("n")
    return rows.select((F.col("g") / n2).alias("footrule"), (F.least("g", "b") / n2).alias("mirrored"), (F.col("m") / F.col("n")).alias("displacement"))


def colocation(g: Graph, first: DataFrame, second: DataFrame, line: int = LINE) -> DataFrame:
    """(agreement): share of edges that both permutations put, or both do not put, in one line."""
    a = first.join(second.select("old_id", F.col("new_id").alias("other")), "old_id")
    s = a.select(F.col("old_id").alias("src"), F.floor(F.col("new_id") / line).alias("s1"), F.floor(F.col("other") / line).alias("s2"))
    d = a.select(F.col("old_id").alias("dst"), F.floor(F.col("new_id") / line).alias("d1"), F.floor(F.col("other") / line).alias("d2"))
    e = g.edges.select("src", "dst").join(s, "src").join(d, "dst")
    return e.agg(F.avg(((F.col("s1") == F.col("d1")) == (F.col("s2") == F.col("d2"))).cast("double")).alias("agreement"))


def amortised(results: DataFrame, reuse: tuple[int, ...] = (1, 2, 10)) -> DataFrame:
    """results (base_time, reordered_time, mapping_time): speedup, break-even uses (null if it never
    pays), least uses for 95 % of the speedup, and the end-to-end speedup at each number of uses."""
    b, r, m = F.col("base_time"), F.col("reordered_time"), F.col("mapping_time")
    out = results.withColumns({
        "speedup": b / r,
        "break_even": F.when(b > r, m / (b - r)),
        "efficient_uses": F.when(r > 0, F.ceil(19 * m / r)),
    })
    return out.withColumns({f"speedup_at_{n}": n * b / (m + n * r) for n in reuse})


def geometric_mean(df: DataFrame, column: str, *by: str) -> DataFrame:
    return df.where(F.col(column) > 0).groupBy(*by).agg(F.exp(F.avg(F.log(column))).alias("geometric_mean"))


def performance_matrix(runs: DataFrame) -> DataFrame:
    """(graph, ordering, benchmark, time): medians over trials; raises where runs of more than
    one condition would be mixed."""
    mixed = runs.groupBy("graph", "ordering", "benchmark").agg(F.count_distinct("condition").alias("n")).where("n > 1")
    if (row := mixed.first()) is not None:
        raise ValueError(f"runs of several conditions: {row.asDict()}")
    return runs.groupBy("graph", "ordering", "benchmark").agg(F.percentile("time_seconds", 0.5).alias("time"))


def flattened_runs(reports: DataFrame) -> DataFrame:
    """Run reports with nested trials as one row a trial."""
    rest = [c for c in reports.columns if c != "trials"]
    return reports.select(*rest, F.posexplode("trials").alias("trial", "t")).select(*rest, "trial", "t.*")
