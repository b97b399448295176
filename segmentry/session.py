"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # hot keys: AQE splits the large partitions of a sort-merge join
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # broadcast only what was measured to be small at run time
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # documents may be long: Arrow batches are bounded by bytes too
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def build_session(app_name: str = "segmentry", master: str | None = None,
                  **extra: str) -> SparkSession:
    """A session with the settings above; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"segmentry-{application}-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder(spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write `df` to the shared folder once and read it back.

    Cuts lineage like a checkpoint and survives lost executors, while later
    readers keep column pruning and filter pushdown. `schema` may name other types
    of the same stored form, such as ML vectors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(schema or df.schema).parquet(path)
    out._scratch_path = path
    return out


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Results of a few jobs that do not need each other, run side by side: one fills the cores that another leaves idle."""
    if not jobs:
        return []
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def release(*stored: DataFrame) -> None:
    """Delete what `materialize` wrote for these tables, once nothing reads them any more."""
    for df in stored:
        if path := getattr(df, "_scratch_path", None):
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
