"""Sharding by sampled splitters.

Records are laid out by a key: the text's hash, then the id, so that equal texts
stand together. A size-weighted sample of keys gives quantile boundaries; the
exact bytes of every range are then counted, and ranges that turned out overfull
get boundaries of their own from a sample within them, until none is. Within a
range a running sum orders the records; the ranges' totals, a bounded list, give
each record its place among all bytes, and so its shard: sizes differ by about
one record. A hot text is cut by id like any other stretch of keys.

Edge cases: a null text has no bytes and size 1; a null id sorts first; rows equal
in text and id are one key and stand side by side in any order; an empty table
gives an empty result; input columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import by_value, table
from loomgraph.runtime import cut, partitions

SHARDS = 8
#: Sampled keys for each range wanted.
PER_RANGE = 24
#: Ranges for each shuffle partition, and at most in all: their totals go to the driver.
RANGES_PER_PARTITION, MOST_RANGES = 4, 65_536
#: A range of over this many times the mean is cut again.
OVERFULL = 2.5
ROUNDS = 4
OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sample_keys(keyed: DataFrame, n: int, salt: int) -> np.ndarray:
    """n keys drawn with chances in proportion to __size, as an array of (hash, id) rows.

    Each record draws -ln(u) / size from its key's hash, and the n least are kept. A
    threshold under which about twice as many lie goes first, so that few rows meet.
    """
    total = keyed.agg(F.sum("__size")).first()[0] or 1
    u = (F.pmod(F.xxhash64(F.lit(salt), "__h", "__id"), F.lit(1 << 52)).cast("double") + 1) / F.lit(float((1 << 52) + 1))
    drawn = keyed.select("__h", "__id", (-F.log(u) / F.col("__size")).alias("w")).where(F.col("w") < (2 * n + 64) / total)
    drawn = drawn.orderBy("w", "__h", "__id").limit(n)
    rows = [(r["__h"], r["__id"]) for r in drawn.collect()]
    return np.array(sorted(set(rows)), np.int64).reshape(-1, 2)


def range_of(bounds: np.ndarray, h: Column, i: Column) -> Column:
    """The number of boundaries (hash, id) at or below a key."""
    first = bounds[:, 0].copy()
    second = bounds[:, 1].copy()

    def find(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        out = hi.copy()
        for k in np.flatnonzero(lo < hi):  # the key's hash is a boundary's: its id decides
            out[k] = lo[k] + np.searchsorted(second[lo[k] : hi[k]], b[k], "right")
        return out

    @F.pandas_udf("int")
    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(find(a.to_numpy(np.int64), b.to_numpy(np.int64)).astype("int32"))

    return place(h, i)


def splitters(keyed: DataFrame, ranges: int) -> np.ndarray:
    """Boundaries of about `ranges` ranges of near equal size, none overfull but by a key."""
    bounds = sample_keys(keyed, ranges * PER_RANGE, 0)
    bounds = bounds[np.unique(np.linspace(0, len(bounds) - 1, ranges + 1).astype(int)[1:-1])] if len(bounds) > 1 else bounds[:0]
    for turn in range(1, ROUNDS):
        marked = keyed.withColumn("__range", range_of(bounds, F.col("__h"), F.col("__id")))
        sums = marked.groupBy("__range").agg(F.sum("__size").alias("s"), F.count_distinct("__h", "__id").alias("k")).collect()
        mean = sum(r["s"] for r in sums) / ranges if sums else 0
        over = [r["__range"] for r in sums if r["s"] > OVERFULL * mean and r["k"] > 1]
        if not over:
            break
        extra = sample_keys(marked.where(F.col("__range").isin(over)), len(over) * 4 * PER_RANGE, turn)
        place = np.concatenate([bounds, extra[:: max(1, PER_RANGE // 4)]])
        bounds = np.unique(place, axis=0)
    return bounds


def shard_by_splitters(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None
) -> DataFrame:
    """`keep` columns of docs (default: all) with size, text_crc32, law, shard, slot and grown_shard."""
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    raw = F.col(text_col).cast("binary")
    keys = {
        "__h": F.coalesce(F.xxhash64(text_col), F.lit(0)),
        "__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))),
        "__size": (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long"),
        "__crc": F.crc32(F.coalesce(raw, F.lit(b""))),
    }
    keyed = docs.withColumns(keys)
    skinny = cut(keyed.select("__h", "__id", "__size"))
    ranges = min(MOST_RANGES, max(shards, RANGES_PER_PARTITION * partitions(spark)))
    bounds = splitters(skinny, ranges)
    where = range_of(bounds, F.col("__h"), F.col("__id"))
    totals = skinny.withColumn("__range", where).groupBy("__range").agg(F.sum("__size").alias("s"), F.count("*").alias("n")).orderBy("__range").collect()
    total = sum(r["s"] for r in totals)
    before, rows, offsets = 0, 0, []
    for r in totals:
        offsets.append((r["__range"], before, rows))
        before, rows = before + r["s"], rows + r["n"]
    held = spark.createDataFrame(offsets or [(0, 0, 0)], "__range int, __before long, __rows long")  # a row a range: bounded
    in_range = Window.partitionBy("__range").orderBy("__h", "__id")
    placed = (
        keyed.select(*kept, *keys)
        .withColumn("__range", where)
        .withColumn("__upto", F.sum("__size").over(in_range.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__rank", F.row_number().over(in_range))
        .join(F.broadcast(held), "__range")
        .withColumn("__middle", F.col("__before") + F.col("__upto") - F.expr("(__size + 1) div 2"))
        .withColumn("shard", F.expr(f"cast(__middle * {shards} div {max(1, total)} as int)"))
        .withColumn("__at", F.col("__rows") + F.col("__rank") - 1)
    )
    # shards are stretches of the key's order: where each begins is the number of rows before it
    light = skinny.withColumn("__range", where).withColumn("__upto", F.sum("__size").over(in_range.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(held), "__range")
    counts = light.groupBy(F.expr(f"cast((__before + __upto - (__size + 1) div 2) * {shards} div {max(1, total)} as int)").alias("shard")).count().collect()
    firsts, at = [], 0
    for r in sorted(counts, key=lambda r: r["shard"]):
        firsts.append((r["shard"], at))
        at += r["count"]
    begin = spark.createDataFrame(firsts or [(0, 0)], "shard int, __first long")
    out = placed.join(F.broadcast(begin), "shard")
    return out.select(
        *kept,
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("__at") - F.col("__first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_by_splitters(docs, keep=("doc_id",))


by_value(__name__)
