"""Communities kept up over a stream of edge changes.

The stream carries (op, src, dst, weight), op `+` or `-`. Each micro-batch is applied
to the edge table, the vertices it affects are screened, and only they and what they
move are labelled anew. State is two Parquet tables, written beside the old version
and then named the current one, so a batch that fails is done again from where it began.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.graph import Graph
from loomgraph.operators.communities import affected_by, label_propagation
from loomgraph.operators.construct import applied_batch

CHANGES = "op string, src long, dst long, weight long"


def latest(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletions and insertions of a batch, each edge at most once; an edge that is both is inserted."""
    tidy = changes.where("src is not null and dst is not null and src <> dst")
    plus = tidy.where("op = '+'").groupBy("src", "dst").agg(F.min(F.coalesce("weight", F.lit(1))).alias("weight"))
    minus = tidy.where("op = '-'").select("src", "dst").distinct().join(plus, ["src", "dst"], "left_anti")
    return minus, plus


class DynamicCommunities:
    def __init__(self, spark: SparkSession, path: str, screening: str = "delta"):
        """screening: `delta` for what a batch touches, `naive` for all vertices, `frontier` for ends only."""
        if screening not in ("delta", "naive", "frontier"):
            raise ValueError(f"unknown screening {screening!r}")
        self.spark, self.path, self.screening = spark, path, screening

    def _version(self) -> int:
        try:
            return self.spark.read.parquet(f"{self.path}/versions").agg(F.max("version")).first()[0]
        except Exception as error:  # the table is not there before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return -1

    def graph(self, version: int | None = None) -> Graph:
        v = self._version() if version is None else version
        if v < 0:
            empty = self.spark.createDataFrame([], "src long, dst long, weight long")
            return Graph(empty.select(F.col("src").alias("id")), empty, False)
        labels = self.labels(v)
        return Graph(labels.select("id"), self.spark.read.parquet(f"{self.path}/edges-{v}"), False)

    def labels(self, version: int | None = None) -> DataFrame:
        v = self._version() if version is None else version
        return self.spark.read.parquet(f"{self.path}/labels-{v}") if v >= 0 else self.spark.createDataFrame([], "id long, community long")

    def apply(self, changes: DataFrame, batch: int = 0) -> None:
        """One micro-batch; also the foreachBatch function."""
        v = self._version()
        old, before = self.graph(v), self.labels(v)
        minus, plus = latest(changes)
        new = applied_batch(old, minus, plus)
        new.edges.write.mode("overwrite").parquet(f"{self.path}/edges-{v + 1}")
        ids = new.vertices.join(before, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
        now = Graph(ids.select("id"), self.spark.read.parquet(f"{self.path}/edges-{v + 1}"), False)
        ends = minus.union(plus.select("src", "dst")).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        screened = {"naive": lambda: ids.select("id"), "frontier": lambda: ends, "delta": lambda: affected_by(now, before, minus, plus).join(ids.select("id"), "id", "left_semi")}[self.screening]()
        label_propagation(now, start=ids, affected=screened).write.mode("overwrite").parquet(f"{self.path}/labels-{v + 1}")
        self.spark.createDataFrame([(v + 1, batch)], "version int, batch long").write.mode("append").parquet(f"{self.path}/versions")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def degree_windows(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, src, edges): edges a vertex sends in each event-time window; later rows than `late` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "src").agg(F.count("*").alias("edges"))
