"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All
but the last return the columns of `documents`; the last adds each row's shard and
slot. run() writes every stage as Parquet into the shared checkpoint folder and
rereads it, so that a lost executor costs a stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, mixing, nearcopies, sharding, simhash, toxicity
from loomgraph.llm.common import table
from loomgraph.runtime import ensure_checkpoint_dir, sweep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity.model_of(docs, table(spark, sf_dir, "labels"))
    sweep(spark)
    return toxicity.score(docs, model).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document of the smallest id stays."""
    sweep(spark)
    return simhash.keep_one(docs, find=nearcopies.near_copies)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their tempered weights: each is passed once at least, so that no document is
    lost, and small ones more often; a document stands as often as its source's passes take it."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard, by near equal bytes, and its slot there."""
    return sharding.shard_by_splitters(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Hashes and models of the stages are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
