"""What the training-data operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomgraph.runtime import bound_batches


def by_value(module: str) -> None:
    """Send the module's functions to Python workers by value, so that executors
    need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch], list],
    fields: list[T.StructField],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """df without `drop`, with columns that compute(batch) makes of a whole batch.

    A column of df with the name of a new one is replaced. Rows keep their
    order and number; an empty df gives an empty result.
    """
    bound_batches(df.sparkSession)
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names and f.name not in drop]
    out = [f.name for f in kept] + [f.name for f in fields]
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=out
            )

    return df.mapInArrow(run, T.StructType(kept + fields))


def utf8(batch: pa.RecordBatch, column: str) -> list:
    """The column's texts as bytes; None stays."""
    return batch.column(column).cast(pa.binary()).to_pylist()


by_value(__name__)
