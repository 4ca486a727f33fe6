"""Session-level helpers: where lineage is cut, and how large Arrow batches are."""

from __future__ import annotations

import sys
import tempfile
import time
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Seconds at least between two collections that `release` asks for.
SWEEP = 5.0
#: Seconds at least between two that it asks of the executors.
FAR_SWEEP = 15.0


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests, a laptop) a
    temporary folder is made; on a cluster the setting must be there, as executors do
    not share local folders.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_flat(df: DataFrame) -> DataFrame:
    """As cut, but by a written table, so that nothing of how rows were made or laid out is kept.

    A checkpoint hands on layouts and all equal expressions it knows; in a loop that
    joins its own result they double with each round, until planning takes longer
    than the work. It also holds on to the shuffles it was made of. Tables that keep a
    layout on purpose take `cut`.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def laid_out(df: DataFrame, key: str = "src") -> DataFrame:
    """df cut once, spread and sorted by a key, and known to be so: loops that join it by
    the key move the other side only."""
    return cut(df.repartition(partitions(df.sparkSession), key).sortWithinPartitions(key))


_swept = _far_swept = 0.0


def release(*done: DataFrame | None) -> None:
    """Delete the files of tables that `cut` or `cut_flat` made and nothing reads any more: all that
    came of them must have been cut itself. Now and then the driver is asked, too, to let go of
    shuffles that nothing refers to, which would else fill the disks in a long loop, and of native
    memory that it has freed; and executors are asked to collect theirs."""
    global _swept
    for df in done:
        if df is None:
            continue
        sc, file = df.sparkSession.sparkContext, getattr(df, "_cut", None)
        if file is None:
            held = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            file = held.get() if held.isDefined() else None
        if file is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        if time.monotonic() > _swept + SWEEP:
            sc._jvm.System.gc()
            trim(sc)
            _swept = time.monotonic()
            if _swept > _far_swept + FAR_SWEEP:
                sweep(df.sparkSession)


def sweep(spark: SparkSession) -> int:
    """Have the executors collect their garbage, and so give back what their heaps grew by; the tasks that did.

    A heap that a stage has filled stays that large, though little in it lives, and Python workers
    come on top. It is a job without a query, as the driver keeps what queries were.
    """
    global _far_swept
    _far_swept = time.monotonic()
    sc = spark.sparkContext
    if sc._jsc.sc().isLocal():
        return 0
    n = sc.defaultParallelism
    return spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc')")._jdf.queryExecution().toRdd().count()


def trim(sc: SparkContext) -> bool:
    """Give native memory that the driver's JVM has freed back to the system, if that JVM can.

    Each query is compiled, and its compilers' memory stays with the C library otherwise: 50 to
    100 MB more after half a minute of a loop of short queries.
    """
    jvm, new = sc._jvm, sc._gateway.new_array
    try:
        of = jvm.java.lang.Class.forName
        kinds = new(jvm.java.lang.Class, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(kind)
        given = new(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the public interface, as the server's own class is not exported
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def bound_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bound the rows of an Arrow batch, as one row may hold a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def by_value(module: str) -> None:
    """Send the module's functions to Python workers by value, so that executors
    need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
