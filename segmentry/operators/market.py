"""Catalog queries: headline counts, developers, top lists, filters, stage facts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions import constants as K
from segmentry.functions.columns import to_number


def market_metrics(chart: DataFrame) -> DataFrame:
    """One row: entries, apps, apps per chart, developers (nulls not counted).

    Rows are first reduced to distinct (app, chart, developer), so the distinct
    counts run on the small table and no hot value travels twice.
    """
    flags = chart.groupBy("app_id", "developer").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.col("chart_type") == "top_free").alias("free"),
        F.max(F.col("chart_type") == "top_paid").alias("paid"))
    apps = flags.groupBy("app_id").agg(
        F.sum("n").alias("n"), F.max("free").alias("free"), F.max("paid").alias("paid"))
    has_id = F.col("app_id").isNotNull()
    totals = apps.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("app_id").alias("unique_games"),
        F.count_if(has_id & F.col("free")).alias("free_games"),
        F.count_if(has_id & F.col("paid")).alias("paid_games"))
    developers = (flags.select("developer").dropna().distinct()
                  .agg(F.count("developer").alias("developers")))
    return totals.withColumn("developers", developers.scalar())


def top_games(chart: DataFrame, chart_type: str, limit: int = 10,
              tie: Sequence[str | Column] = ("app_id",)) -> DataFrame:
    """Best positions of one chart; ties by `tie`."""
    return (chart.filter(F.col("chart_type") == chart_type)
            .orderBy("chart_position", *tie).limit(limit))


def developer_presence(chart: DataFrame, limit: int = 10) -> DataFrame:
    """Developers with most ranked games, then most entries, then by name."""
    per_app = (chart.dropna(subset=["developer"]).groupBy("developer", "app_id")
               .agg(F.count(F.lit(1)).alias("n")))
    return (per_app.groupBy("developer")
            .agg(F.count("app_id").alias("ranked_games"), F.sum("n").alias("chart_entries"))
            .orderBy(F.desc("ranked_games"), F.desc("chart_entries"), "developer").limit(limit))


def segment_members(games: DataFrame, cluster_id: int) -> DataFrame:
    """Rows of one segment."""
    return games.filter(F.col("cluster_id") == cluster_id)


def segment_lookup(scores: DataFrame, cluster_id: int,
                   order: Sequence[str | Column] = ("opportunity_rank",)) -> DataFrame:
    """One row of a segment, or none."""
    return segment_members(scores, cluster_id).orderBy(*order).limit(1)


def category_filter(df: DataFrame, column: str, chosen: Sequence[str] | None = None) -> DataFrame:
    """Rows whose category is chosen; by default every non-null category."""
    if chosen is None:
        return df.filter(F.col(column).isNotNull())
    return df.filter(F.col(column).isin(*chosen))


def category_options(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null categories in order."""
    return df.select(column).dropna().distinct().orderBy(column)


def concept_candidates(scores: DataFrame) -> DataFrame:
    """Segments fit for concepts: not mixed, best adjusted score first."""
    return (scores.filter(F.col("segment_type") != K.MIXED_TYPE)
            .orderBy(F.desc("adjusted_opportunity_score"), "cluster_id"))


def enrichment_quality(enriched: DataFrame) -> DataFrame:
    """One row: rows, metadata found and missing, ratings and descriptions present."""
    return enriched.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("metadata_found").alias("metadata_found"),
        F.count_if(~F.col("metadata_found")).alias("metadata_missing"),
        F.count("average_rating").alias("ratings_available"),
        F.count("description").alias("descriptions_available"))


def facts(stage: str, row: DataFrame) -> DataFrame:
    """A one-row table as (stage, fact, value) rows; absent values are left out."""
    pairs = F.array(*[F.struct(F.lit(name).alias("fact"), F.col(f"`{name}`").cast("string").alias("value"))
                      for name in row.columns])
    return (row.select(F.explode(pairs).alias("p"))
            .select(F.lit(stage).alias("stage"), "p.fact", "p.value")
            .filter(F.col("value").isNotNull()))


def stage_facts(charts: DataFrame | None = None, enriched: DataFrame | None = None,
                summary: DataFrame | None = None, clustered: DataFrame | None = None,
                scores: DataFrame | None = None, reviews: DataFrame | None = None,
                coverage: DataFrame | None = None, pain_points: DataFrame | None = None,
                links: DataFrame | None = None) -> DataFrame:
    """Facts of each stage whose table is given, as (stage, fact, value)."""
    parts: list[DataFrame] = []
    if charts is not None:
        parts.append(facts("collect", charts.agg(
            F.count(F.lit(1)).alias("rows_collected"),
            F.count_if(F.col("chart_type") == "top_free").alias("top_free"),
            F.count_if(F.col("chart_type") == "top_paid").alias("top_paid"))))
    if enriched is not None:
        # one scan: Spark expands rows to the two distinct columns and combines them map-side
        parts.append(facts("enrich", enriched.agg(
            F.count_distinct("app_id").alias("unique_games"), F.count_distinct("developer").alias("developers"),
            F.count_if(F.length(F.coalesce("description", F.lit(""))) > 0).alias("descriptions"))))
    if summary is not None:
        parts.append(facts("cluster", summary.agg(F.count(F.lit(1)).alias("segments_discovered"))))
    if clustered is not None:
        parts.append(facts("cluster", distinct_count(clustered, "app_id", "games_segmented")))
    if scores is not None:
        score = ("adjusted_opportunity_score" if "adjusted_opportunity_score" in scores.columns
                 else "opportunity_score")
        best = F.struct(F.col(score), -F.col("cluster_id"), F.col("cluster_name"))
        parts.append(facts("opportunities", scores.agg(
            F.count(F.lit(1)).alias("segments_ranked"),
            F.max_by("cluster_name", best).alias("top_signal"),
            F.format_string("%.1f/100", F.max(score)).alias("top_score"))))
    if reviews is not None:
        parts.append(facts("reviews", reviews.agg(
            F.count(F.lit(1)).alias("reviews_collected"),
            F.count_if(to_number(F.col("review_rating")) <= 2).alias("negative_reviews"))))
    if coverage is not None:
        parts.append(facts("reviews", coverage.agg(
            F.count_if(F.coalesce(to_number(F.col("reviews_collected")), F.lit(0.0)) > 0)
            .alias("apps_with_reviews"))))
    if pain_points is not None:
        parts.append(facts("pain_points", pain_points.agg(
            F.count(F.lit(1)).alias("pain_point_groups"))))
    if links is not None:
        parts.append(facts("pain_points", distinct_count(
            links, "cluster_id", "segments_with_review_evidence")))
    if not parts:
        raise ValueError("no stage table was given")
    return reduce(DataFrame.unionByName, parts)


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row with the number of distinct non-null values of a column."""
    return df.select(column).dropna().distinct().agg(F.count(F.lit(1)).alias(name))


def snapshot_summary(enriched: DataFrame, scores: DataFrame, reviews: DataFrame,
                     pain_points: DataFrame) -> DataFrame:
    """One row: games, segments, reviews, pain points."""
    rows = F.count(F.lit(1))
    return (distinct_count(enriched, "app_id", "games")
            .withColumn("segments", scores.agg(rows).scalar())
            .withColumn("reviews", reviews.agg(rows).scalar())
            .withColumn("pain_points", pain_points.agg(rows).scalar()))
