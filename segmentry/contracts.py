"""Checks on columns, keys and sample sizes, raised before work is spent."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: A guard that asks for one row of any kind.
CHECKED = (None, 1)


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required names that `df` lacks, sorted."""
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str], table: str = "table") -> DataFrame:
    """`df` unchanged, or ValueError with the sorted missing names."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{table} is missing required columns: {', '.join(missing)}")
    return df


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null keys held by more than one row, with the number of rows.

    A grouped count: rows combine map-side, so one hot key costs one row per task.
    """
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return (df.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
            .filter(F.col("key_rows") > 1))


def assert_unique(df: DataFrame, keys: Sequence[str], table: str = "table") -> DataFrame:
    """`df` unchanged, or ValueError if a key occurs twice (runs one job)."""
    if not key_violations(df, keys).isEmpty():
        raise ValueError(f"{table} is not unique on {', '.join(keys)}")
    return df


def require_rows(df: DataFrame, minimum: int, what: str = "rows") -> DataFrame:
    """`df` unchanged, or ValueError if it has fewer than `minimum` rows.

    Counts over `limit(minimum)`, so the job stops early on large inputs.
    """
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"too few usable {what}: {found}, need {minimum}")
    return df


def stored_checked(df: DataFrame, path: str, guards: Mapping[str, tuple[Column | None, int]]) -> DataFrame:
    """Write `df` to `path`, check guards on what was written, and read it back.

    `guards` maps what is counted to (condition, minimum), without a condition all rows. Rows are counted by
    the write itself, so no guard needs a job or a scan of its own. Too few raise ValueError when the
    write ends; the table stays for inspection.
    """
    if guards:
        seen = Observation()
        counts = [F.count(F.lit(1)) if condition is None else F.count_if(condition) for condition, _ in guards.values()]
        df = df.observe(seen, *(c.alias(f"guard_{i}") for i, c in enumerate(counts)))
    df.write.mode("overwrite").parquet(path)
    for i, (what, (_, minimum)) in enumerate(guards.items()):
        found = seen.get[f"guard_{i}"]
        if found < minimum:
            raise ValueError(f"too few usable {what}: {found}, need {minimum}")
    return df.sparkSession.read.schema(df.schema).parquet(path)
