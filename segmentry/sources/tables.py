"""Tables at rest: contracts, snapshots, bundles, sinks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.contracts import require_columns
from segmentry.functions.columns import normalize_id, to_number
from segmentry.operators.rows import first_per_key, lookup_join
from segmentry.schemas import TABLES

SNAPSHOT_COLUMNS = ("app_id", "title", "developer", "chart_type", "chart_position")


def read_csv(spark: SparkSession, path: str, schema: str, required: Sequence[str] = (),
             table: str = "table", multi_line: bool = True) -> DataFrame:
    """CSV with a header and an explicit schema; bad values become null.

    The header decides which columns exist, so a missing required one is reported.
    Quoted cells may hold line breaks; turn `multi_line` off to split large files.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    present = reader.csv(path).columns
    fields = [f.strip() for f in schema.split(", ")]
    typed = {f.split()[0]: f.split()[1] for f in fields}
    text = reader.schema(", ".join(f"`{c}` string" for c in present)).csv(path)
    require_columns(text, required, table)
    return text.select(*[F.col(c).try_cast(typed.get(c, "string")).alias(c) for c in present])


def read_table(spark: SparkSession, path: str, required: Sequence[str] = (),
               table: str = "table") -> DataFrame:
    """Parquet table with a required-column check."""
    return require_columns(spark.read.parquet(path), required, table)


def read_or_empty(spark: SparkSession, path: str, schema: str, csv: bool = False) -> DataFrame:
    """Table at `path` (Parquet, or CSV with a header), or an empty one with `schema` where it cannot be read.

    Reading the footers, or the first lines, decides: a missing path, a file of another kind and missing
    columns all give the empty table. Blocks damaged further on still fail the job that reads them.
    """
    try:
        found = read_csv(spark, path, schema) if csv else spark.read.parquet(path)
        found.limit(1).collect()
        return found
    except (AnalysisException, Py4JJavaError, PySparkException):
        return spark.createDataFrame([], schema)


def load_bundle(spark: SparkSession, root: str, register: bool = False, csv: bool = False) -> dict[str, DataFrame]:
    """All named tables below `root`, each checked; optionally as temporary views.

    Tables are Parquet folders, or with `csv` files named `<table>.csv`.
    """
    bundle = {}
    for name, (schema, required) in TABLES.items():
        bundle[name] = (read_csv(spark, f"{root}/{name}.csv", schema, required, name) if csv
                        else read_table(spark, f"{root}/{name}", required, name))
        if register:
            bundle[name].createOrReplaceTempView(name)
    return bundle


def latest_snapshot(df: DataFrame, column: str = "snapshot_ts") -> DataFrame:
    """Rows of the newest snapshot.

    The newest value is a one-row subquery. Where `column` is a partition column,
    Spark prunes the other partitions with it.
    """
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def latest_file(spark: SparkSession, path: str, format: str = "csv", **options) -> DataFrame:
    """Rows of the file under `path` that was modified last (ties: greatest name); no other file is read.

    The newest file counts even if it holds a header only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("modificationTime", "path")
    newest = files.agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()["m"]
    if newest is None:
        raise FileNotFoundError(f"no file under {path}")
    return spark.read.format(format).options(**options).load(newest["path"])


def clean_snapshot(charts: DataFrame) -> DataFrame:
    """Typed chart rows without null key columns."""
    require_columns(charts, SNAPSHOT_COLUMNS, "snapshot")
    typed = charts.withColumn("chart_position", to_number(F.col("chart_position")))
    return (typed.dropna(subset=["app_id", "title", "chart_type", "chart_position"])
            .withColumn("app_id", F.col("app_id").cast("string"))
            .withColumn("chart_position", F.col("chart_position").cast("int")))


def load_snapshot(charts: DataFrame) -> DataFrame:
    """Typed chart rows in (chart, position) order."""
    return clean_snapshot(charts).orderBy("chart_type", "chart_position")


def chart_keys(charts: DataFrame, order: Sequence[str | Column] = ("chart_position",)) -> DataFrame:
    """Chart rows with cleaned ids, first per app and chart."""
    clean = charts.withColumn("app_id", normalize_id(F.col("app_id")))
    return first_per_key(clean, ["app_id", "chart_type"], order)


def catalog_games(enriched: DataFrame, order: Sequence[str | Column] = ("chart_type", "chart_position")) -> DataFrame:
    """One row per app with default title and developer."""
    clean = (enriched.withColumn("app_id", normalize_id(F.col("app_id")))
             .fillna({"title": "Unknown game", "developer": "Unknown"}))
    return first_per_key(clean, ["app_id"], order)


def unique_metadata(metadata: DataFrame, order: Sequence[str | Column] = ()) -> DataFrame:
    """One lookup record per app_id: the first in `order`, or of equal records any."""
    rest = [F.col(c) for c in metadata.columns if c != "app_id"]
    return first_per_key(metadata, ["app_id"], list(order) or rest)


def enrich(charts: DataFrame, metadata: DataFrame, check: bool = True) -> DataFrame:
    """Charts left-joined to metadata on app_id, with `metadata_found`.

    `check` makes sure of one record per app, so no chart row doubles; drop repeated lookup records
    first with `unique_metadata`.


    Names on both sides get the suffixes _x (chart) and _y (metadata).
    """
    shared = (set(charts.columns) & set(metadata.columns)) - {"app_id"}
    left = charts.withColumnsRenamed({c: f"{c}_x" for c in shared})
    right = metadata.withColumnsRenamed({c: f"{c}_y" for c in shared})
    return (lookup_join(left, right, "app_id", check, "metadata")
            .withColumn("metadata_found", F.col("description").isNotNull()))


def described_games(enriched: DataFrame, min_length: int = 50) -> DataFrame:
    """Rows whose trimmed description has at least `min_length` characters, typed."""
    text = F.btrim(F.coalesce("description", F.lit("")), F.lit(" \t\n\r\f\u000b"))
    return (enriched.withColumn("description", text).filter(F.length("description") >= min_length)
            .withColumns({
                "app_id": normalize_id(F.col("app_id"), strip=False),
                "average_rating": to_number(F.col("average_rating")),
                "rating_count": to_number(F.col("rating_count")),
                "chart_position": to_number(F.col("chart_position"))}))


def write_table(df: DataFrame, path: str, csv: bool = False) -> None:
    """Replace the table at `path`; Parquet, or CSV with a header for export."""
    writer = df.write.mode("overwrite")
    if csv:
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def snapshot_stamp(now: datetime | None = None) -> str:
    """Snapshot name in UTC, such as 20240131_235959."""
    return (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y%m%d_%H%M%S")


def append_snapshot(df: DataFrame, path: str, snapshot_ts: str) -> None:
    """Add a snapshot as its own partition; writing it again replaces that one only."""
    (df.withColumn("snapshot_ts", F.lit(snapshot_ts)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_ts").parquet(path))
