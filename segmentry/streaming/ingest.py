"""Landed review pages into a table, in steps that survive a crash.

A file stream with an available-now trigger takes the place of a saved copy after
every few games: its checkpoint records what is loaded, each step writes its own
partition, and a step that is repeated replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.sources.feeds import review_rows


#: What makes a review the same one: only its digest is kept as state.
SAME = ("app_id", "review_id", "review_text")


def load_reviews(spark: SparkSession, landed: str, out: str, state: str,
                 files_per_step: int = 20, unique: bool = False) -> None:
    """Load all landed pages not loaded before; returns when none is left.

    Pages are Parquet rows (app_id, game_title, developer, page_number, doc).
    `state` keeps the progress and must stay with `out`. With `unique`, a review that an earlier step or
    page has (SAME) is not loaded again: the stream keeps a digest of each, 16 bytes, in its state store
    (choose RocksDB there for large tables). A step that is repeated after a crash starts from the state of
    the step before and replaces its own output, so nothing is lost or doubled.
    """
    schema = spark.read.parquet(landed).schema
    pages = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(landed))

    def write_step(rows: DataFrame, step: int) -> None:
        (rows.withColumn("batch_id", F.lit(step)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out))

    rows = review_rows(pages)
    if unique:
        parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in SAME]
        rows = rows.withColumn("digest", F.unhex(F.md5(F.concat(*parts)))).dropDuplicates(["digest"]).drop("digest")
    query = (rows.writeStream.foreachBatch(write_step)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()


def compact(spark: SparkSession, out: str, into: str, file_rows: int = 5_000_000) -> DataFrame:
    """All loaded reviews rewritten as few large files at `into`, which replaces an older copy, and read back."""
    rows = compacted(spark, out).hint("rebalance")
    rows.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(into)
    return spark.read.parquet(into)


def compacted(spark: SparkSession, out: str) -> DataFrame:
    """All loaded reviews without the step number."""
    return spark.read.parquet(out).drop("batch_id")
