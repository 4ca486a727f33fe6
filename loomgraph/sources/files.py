"""Graph files: edge lists, MatrixMarket, DIMACS, binary CSR and permutations."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import Graph, numbered
from loomgraph.runtime import by_value


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("l")).where("l <> ''")
    return lines.select("l", F.split("l", r"\s+").alias("f"))


def _numbers(f: DataFrame, columns: dict[str, int], shift: int = 0) -> DataFrame:
    return f.select(*((F.element_at("f", i + 1).cast("long") - (shift if n in ("src", "dst") else 0)).alias(n) for n, i in columns.items()))


def read_el(spark: SparkSession, path: str) -> DataFrame:
    """`src dst` a line; # starts a comment."""
    return _numbers(_fields(spark, path).where("not l like '#%'"), {"src": 0, "dst": 1})


def read_wel(spark: SparkSession, path: str) -> DataFrame:
    """`src dst weight` a line; a fractional weight is cut to a whole number."""
    f = _fields(spark, path).where("not l like '#%'")
    return f.select(F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"), F.col("f")[2].cast("double").cast("long").alias("weight"))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """MatrixMarket coordinates, 1-based: pattern, integer or real; a symmetric one is mirrored."""
    head = spark.read.text(path).where("value like '%%MatrixMarket%'").first()
    kinds = head[0].lower().split() if head else []
    body = _fields(spark, path).where("not l like '\\%%'")
    # the first line after the comments holds the dimensions: the one nothing precedes
    first = body.withColumn("at", F.monotonically_increasing_id()).agg(F.min("at")).first()[0]
    rows = body.withColumn("at", F.monotonically_increasing_id()).where(F.col("at") != F.lit(-1 if first is None else first))
    weight = F.lit(1).cast("long") if "pattern" in kinds else F.coalesce(F.try_element_at("f", F.lit(3)).cast("double").cast("long"), F.lit(1))
    out = rows.select((F.col("f")[0].cast("long") - 1).alias("src"), (F.col("f")[1].cast("long") - 1).alias("dst"), weight.alias("weight"))
    if "symmetric" in kinds:
        out = out.union(out.where("src <> dst").select("dst", "src", "weight"))
    return out


def read_gr(spark: SparkSession, path: str) -> DataFrame:
    """DIMACS arcs `a src dst weight`, 1-based."""
    return _numbers(_fields(spark, path).where("l like 'a %'"), {"src": 1, "dst": 2, "weight": 3}, 1)


def read_binary(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """A serialised CSR: bool directed, int64 edges and nodes, int64 offsets, int32 neighbours (with an
    int32 weight each if weighted). Read whole by one task a file; Parquet is the format for large graphs."""
    size = 8 if weighted else 4

    def decode(pdf):
        for batch in pdf:
            for raw in batch["content"]:
                _, m, n = struct.unpack_from("<?qq", raw, 0)
                offsets = np.frombuffer(raw, "<i8", n + 1, 17)
                cells = np.frombuffer(raw, "<i4", m * size // 4, 17 + 8 * (n + 1)).reshape(m, -1)
                src = np.repeat(np.arange(n), np.diff(offsets))
                yield pd.DataFrame({"src": src, "dst": cells[:, 0].astype(np.int64), "weight": cells[:, 1].astype(np.int64) if weighted else 1})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "src long, dst long, weight long")


def binary_bytes(edges: list[tuple], n: int, directed: bool, weighted: bool = False) -> bytes:
    """The serialised CSR of a small graph's sorted rows."""
    out = io.BytesIO()
    degree = np.bincount([e[0] for e in edges], minlength=n) if edges else np.zeros(n, int)
    out.write(struct.pack("<?qq", directed, len(edges), n))
    out.write(np.concatenate([[0], np.cumsum(degree)]).astype("<i8").tobytes())
    rows = sorted(edges)
    cells = np.array([[e[1], e[2]] if weighted else [e[1]] for e in rows], "<i4")
    out.write(cells.tobytes())
    return out.getvalue()


def read(spark: SparkSession, path: str) -> DataFrame:
    """By the file's ending; anything else is Parquet with src and dst."""
    for end, reader in {".el": read_el, ".wel": read_wel, ".mtx": read_mtx, ".gr": read_gr, ".sg": read_binary}.items():
        if path.endswith(end):
            return reader(spark, path)
    if path.endswith(".wsg"):
        return read_binary(spark, path, True)
    return spark.read.parquet(path)


def read_permutation(spark: SparkSession, path: str) -> DataFrame:
    """(old_id, new_id): Parquet of both, or text with `old new`, or with one new id a line in id order."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select("old_id", "new_id")
    f = _fields(spark, path)
    if f.where(F.size("f") > 1).isEmpty():
        laid = f.select(F.col("f")[0].cast("long").alias("new_id"), F.monotonically_increasing_id().alias("at"))
        return numbered(laid, F.col("at"), name="old_id").select("old_id", "new_id")
    return f.select(F.col("f")[0].cast("long").alias("old_id"), F.col("f")[1].cast("long").alias("new_id"))


def write_el(g: Graph, path: str, weighted: bool = False) -> None:
    columns = ["src", "dst", "weight"] if weighted else ["src", "dst"]
    g.edges.select(F.concat_ws(" ", *columns).alias("value")).write.mode("overwrite").text(path)


def write_mtx(g: Graph, path: str, weighted: bool = False) -> None:
    """Parts of one file in order: the header is the first part's first lines."""
    n, m = g.edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0))).first()[0], g.edges.count()
    kind = "integer" if weighted else "pattern"
    head = g.edges.sparkSession.createDataFrame([(0, f"%%MatrixMarket matrix coordinate {kind} general"), (1, f"{n} {n} {m}")], "o long, value string")
    cells = [F.col("src") + 1, F.col("dst") + 1] + ([F.col("weight")] if weighted else [])
    rows = g.edges.select((F.col("src") + 2).alias("o"), F.concat_ws(" ", *cells).alias("value"))
    head.union(rows).repartitionByRange("o").sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_adjacency(g: Graph, path: str) -> None:
    """The text adjacency format: a title, n, m, then all offsets and all neighbours, a line each."""
    from loomgraph.operators.construct import offsets

    n, m = g.vertices.count(), g.edges.count()
    head = g.edges.sparkSession.createDataFrame([(0, 0, 0, "AdjacencyGraph"), (0, 1, 0, str(n)), (0, 2, 0, str(m))], "k int, a long, b long, value string")
    starts = offsets(g).select(F.lit(1).alias("k"), F.col("id").alias("a"), F.lit(0).alias("b"), F.col("start").cast("string").alias("value"))
    cells = g.edges.select(F.lit(2).alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").cast("string").alias("value"))
    all_ = head.union(starts).union(cells)
    all_.repartitionByRange("k", "a", "b").sortWithinPartitions("k", "a", "b").select("value").write.mode("overwrite").text(path)


def write_csr(g: Graph, path: str) -> None:
    """Offsets and rows as Parquet."""
    from loomgraph.operators.construct import offsets, rows

    offsets(g).write.mode("overwrite").parquet(f"{path}/offsets")
    rows(g).write.mode("overwrite").parquet(f"{path}/rows")


def write_permutation(mapping: DataFrame, path: str, text: bool = False) -> None:
    if text:
        mapping.select(F.concat_ws(" ", "old_id", "new_id").alias("value")).write.mode("overwrite").text(path)
    else:
        mapping.select("old_id", "new_id").write.mode("overwrite").parquet(path)


RUNS = "graph string, spec string, benchmark string, trial int, time_seconds double, verified boolean, answer string"


def record_runs(runs: DataFrame, path: str) -> None:
    """Appends run records to a table; writers add files and never touch each other's."""
    runs.select("graph", "spec", "benchmark", "trial", "time_seconds", "verified", "answer").write.mode("append").parquet(path)


def record_sources(sources: DataFrame, path: str) -> None:
    """A manifest (octile, id) of a graph's chosen sources as JSON lines."""
    sources.coalesce(1).write.mode("overwrite").json(path)


by_value(__name__)
