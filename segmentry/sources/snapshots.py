"""A snapshot store: data by snapshot and attempt, and a manifest that says which attempts are whole.

A snapshot is written to a folder of its own attempt first; the line in the manifest is written last
and is what makes it count. A half-written snapshot, or a half-done rewrite of an old one, is
therefore never read, and readers of the old attempt are not disturbed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "snapshot_ts string, attempt string, rows long, committed_at timestamp"


def write_attempt(df: DataFrame, path: str, snapshot_ts: str) -> tuple[str, int]:
    """Write the rows of a snapshot under a new attempt without committing it: (attempt, rows)."""
    attempt, seen = uuid.uuid4().hex, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/data/snapshot_ts={snapshot_ts}/attempt={attempt}")
    return attempt, seen.get["rows"]


def commit_snapshot(df: DataFrame, path: str, snapshot_ts: str) -> int:
    """Add a snapshot, or replace it by a new attempt, and return its rows. They are counted as they are written."""
    spark = df.sparkSession
    attempt, rows = write_attempt(df, path, snapshot_ts)
    line = spark.createDataFrame([(snapshot_ts, attempt, rows)], "snapshot_ts string, attempt string, rows long")
    line.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return rows


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One line per whole snapshot: its attempt committed last (ties: greatest name) and its rows."""
    try:
        lines = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        lines = spark.createDataFrame([], MANIFEST)
    last = F.max(F.struct("committed_at", "attempt", "rows")).alias("last")
    return lines.groupBy("snapshot_ts").agg(last).select("snapshot_ts", "last.attempt", "last.rows", "last.committed_at")


def all_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all whole snapshots with `snapshot_ts`; other attempts are pruned by the manifest at run time."""
    data = spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")
    # a line per snapshot; Spark broadcasts it by its size and prunes the folders of the other attempts
    return data.join(manifest(spark, path).select("snapshot_ts", "attempt"), ["snapshot_ts", "attempt"]).drop("attempt")


def read_snapshot(spark: SparkSession, path: str, snapshot_ts: str | None = None) -> DataFrame:
    """Rows of one whole snapshot, the newest by default; only its folder is read.

    FileNotFoundError if there is none.
    """
    lines = manifest(spark, path)
    chosen = (lines if snapshot_ts is None else lines.filter(F.col("snapshot_ts") == snapshot_ts)).orderBy(F.desc("snapshot_ts")).first()
    if chosen is None:
        raise FileNotFoundError(f"no whole snapshot{'' if snapshot_ts is None else ' ' + snapshot_ts} under {path}")
    folder = f"{path}/data/snapshot_ts={chosen['snapshot_ts']}/attempt={chosen['attempt']}"
    return spark.read.parquet(folder).withColumn("snapshot_ts", F.lit(chosen["snapshot_ts"]))
