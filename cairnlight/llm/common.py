"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a pattern's character range (fixed by the queries' contracts).
SPACE = r"\x20\x09-\x0D"


#: Bytes of a batch that goes to Python. Spark's own bound of 64 MB is held several times by each running task.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # nothing else was asked for
        spark.conf.set(key, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda's outer columns are otherwise evaluated anew for each element whenever the optimizer inlines them.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where the cluster names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='cairnlight-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairnlight/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: a lost executor then costs its tasks, not the whole plan."""
    spark = df.sparkSession
    path = work_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cairnlight_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once no later plan reads them."""
    for df in tables:
        path = getattr(df, "_cairnlight_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def let_go(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that finished stages no longer need, and executors give back their heap.

    A heap stays at the most that a stage has taken until all of it is collected; the next stages' workers add to it.
    """
    for _ in range(2):  # the first lets the JVM see what Python has dropped
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
    slots = spark.sparkContext.defaultParallelism  # idle slots take a task each, so every executor has one
    spark.range(0, slots, 1, slots).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def local_path(path: str) -> str:
    return os.fspath(path)
