"""Graphs derived from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_supplier(spark: SparkSession, sf_dir: str, first: str | None = None, end: str | None = None) -> DataFrame:
    """Bipartite edges from customers (2 * key) to suppliers (2 * key + 1), one for each pair,
    of the lines shipped in [first, end)."""
    lines = table(spark, sf_dir, "lineitem")
    if first:
        lines = lines.where(F.col("l_shipdate") >= F.lit(first).cast("timestamp_ntz"))
    if end:
        lines = lines.where(F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    both = lines.select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()


def month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of January 1995: several components at every scale."""
    return customer_supplier(spark, sf_dir, "1995-01-01", "1995-02-01")


def parts_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts a < b of one order, a row for each order with both."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey is not null")
    held = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("p"))
    return held.select("p", F.posexplode("p").alias("i", "src")).select("src", F.explode(F.expr("slice(p, i + 2, size(p))")).alias("dst"))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges from a supplier's nation to a customer's, weighted by lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    both = lines.join(orders, "l_orderkey").groupBy("l_suppkey", "c_custkey").count()
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    named = both.join(suppliers, "l_suppkey").join(customers, "c_custkey")
    return named.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg(F.sum("count").alias("weight"))


def user_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed edges between the users of consecutive events by (ts, event_id), u <> v.

    Days are taken apart: the next event within a day by a window, and for a day's
    last event the first of the next day that has any.
    """
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id").withColumn("day", F.to_date("ts"))
    order = Window.partitionBy("day").orderBy("ts", "event_id")
    inside = events.withColumn("next", F.lead("user_id").over(order)).withColumn("last", F.lead("event_id").over(order).isNull())
    firsts = events.groupBy("day").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("f"))
    after = firsts.select("day", F.lead("f.user_id").over(Window.orderBy("day")).alias("first"))  # a row a day
    joined = inside.join(F.broadcast(after), "day", "left")
    pairs = joined.select(F.col("user_id").alias("src"), F.when(F.col("last"), F.col("first")).otherwise(F.col("next")).alias("dst"))
    return pairs.where("src <> dst").distinct()
