"""Row selection: first per key, distinct keys, top rows, numbering, checked joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.contracts import assert_unique
from segmentry.session import materialize

_RN = "__rn"
#: Segments at most where one value of each is looked up: sweeps try far fewer clusters.
SEGMENTS = 5_000


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """First row of each key in `order`.

    Spark plans the `= 1` filter as a group limit before the shuffle, so a key
    that holds a third of all rows sends one row per task, not all of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(_RN, F.row_number().over(window)).filter(F.col(_RN) == 1).drop(_RN)


def top_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column],
                limit: int, rank: str = "rank") -> DataFrame:
    """First `limit` rows of each key with their rank (group limit before the shuffle)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of one column."""
    return df.select(column).dropna().distinct()


def lookup_join(left: DataFrame, right: DataFrame, key: str | Sequence[str],
                check: bool = False, table: str = "lookup") -> DataFrame:
    """Left equi-join to a table that is unique on `key`, so no left row multiplies.

    No side is hinted: Spark broadcasts what it measures to be small, otherwise it
    sort-merges and splits hot left keys at run time. `check` verifies the key first.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if check:
        assert_unique(right, keys, table)
    return left.join(right, keys, "left")


def small_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join to an aggregate that should be small, such as one row per segment.

    No side is hinted: adaptive execution broadcasts the aggregate by its measured bytes, else it
    sort-merges and splits hot partitions.
    """
    return left.join(right, [key] if isinstance(key, str) else list(key), how)


def per_segment(table: DataFrame, key: str, value: Column, limit: int = SEGMENTS) -> Column:
    """`value` of the row of `table` with each key, as one map for all rows: nothing is shuffled to look it up.

    `table` has one row per segment; more than `limit` of them raise an error when the plan runs.
    """
    entries = F.collect_list(F.struct(F.col(key), value))
    message = F.lit(f"more than {limit} rows in a table of one row per {key}")
    looked_up = table.filter(F.col(key).isNotNull()).agg(
        F.when(F.count(F.lit(1)) > limit, F.raise_error(message)).otherwise(F.map_from_entries(entries)).alias("m")).scalar()
    return F.try_element_at(looked_up, F.col(key))


def number_rows(df: DataFrame, order: Sequence[str | Column], column: str = "row_index",
                partitions: int | None = None) -> DataFrame:
    """Consecutive numbers 1..n over the whole table in `order`, without one big task.

    Rows are range-partitioned and written once with their partition number; each
    partition is then numbered by itself and shifted by the sizes of those before
    it. Only one row per partition takes part in the shift.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, size, shift = "__part", "__size", "__shift"
    ranged = materialize(
        df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(size))
    # at most `n` rows
    shifts = sizes.select(part, F.coalesce(F.sum(size).over(
        Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(shift))
    local = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return (ranged.withColumn(column, local.cast("long")).join(F.broadcast(shifts), part)
            .withColumn(column, F.col(column) + F.col(shift)).drop(part, shift))


def id_batches(ids: DataFrame, column: str, order: Sequence[str | Column],
               batch_size: int = 25, partitions: int | None = None) -> DataFrame:
    """Consecutive groups of `batch_size` ids: batch_id (0-based), ids, batch_rows."""
    numbered = number_rows(ids, order, "__n", partitions)
    batch = F.floor((F.col("__n") - 1) / batch_size).cast("long")
    return (numbered.groupBy(batch.alias("batch_id"))
            .agg(F.array_sort(F.collect_list(F.struct("__n", column))).alias("__items"),
                 F.count(F.lit(1)).alias("batch_rows"))
            .select("batch_id", F.col(f"__items.{column}").alias("ids"), "batch_rows"))
