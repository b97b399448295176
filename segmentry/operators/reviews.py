"""Reviews: cleaning, dedupe, negatives, segment links, coverage, pain points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions.columns import round_even, split_list, to_number, to_timestamp_utc, truth
from segmentry.functions.text import clean_review, clip_example
from segmentry.operators.rows import first_per_key, lookup_join, top_per_key


def valid_reviews(reviews: DataFrame) -> DataFrame:
    """Typed reviews with a rating of 1..5 and a trimmed text of at least 5 characters."""
    typed = reviews.withColumns({
        "review_rating": to_number(F.col("review_rating")),
        "review_text": F.btrim(F.coalesce("review_text", F.lit("")), F.lit(" \t\n\r\f\u000b")),
        "review_date": to_timestamp_utc(F.col("review_date")),
    })
    return typed.filter(F.col("review_rating").between(1, 5) & (F.length("review_text") >= 5))


def dedupe_reviews(reviews: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """First review per app, review id (null reads as empty) and text."""
    review_id = F.coalesce("review_id", F.lit(""))
    return first_per_key(reviews, ["app_id", review_id, "review_text"], order)


def negative_reviews(reviews: DataFrame, order: Sequence[str | Column],
                     max_rating: int = 2, min_length: int = 15) -> DataFrame:
    """Ratings up to `max_rating` whose cleaned text is long enough, one per app and text.

    Copies are dropped first (the cleaned length depends on the text alone, so the
    result is the same), which cleans each text once.
    """
    low = reviews.filter(to_number(F.col("review_rating")) <= max_rating)
    single = first_per_key(low, ["app_id", "review_text"], order)
    return (single.withColumn("cleaned_review", clean_review(F.col("review_text")))
            .filter(F.length("cleaned_review") >= min_length))


def segment_map(games: DataFrame, order: Sequence[str | Column] = ("cluster_id",)) -> DataFrame:
    """One segment per app."""
    return first_per_key(games.select("app_id", "cluster_id"), ["app_id"], order)


def attach_segments(reviews: DataFrame, segments: DataFrame, check: bool = False) -> DataFrame:
    """Reviews with the segment of their app; unmatched keep a null segment."""
    return lookup_join(reviews, segments, "app_id", check, "segment map")


def segment_pain_points(linked: DataFrame, min_reviews: int = 8) -> DataFrame:
    """Pain-point counts and shares inside each segment, from row-level links."""
    counts = (linked.dropna(subset=["cluster_id", "pain_point_id"])
              .groupBy("cluster_id", "pain_point_id").agg(F.count(F.lit(1)).alias("review_count")))
    return _shares(counts, min_reviews)


def segment_pain_points_from_apps(reviews: DataFrame, segments: DataFrame, min_reviews: int = 8) -> DataFrame:
    """The same from reviews and the app -> segment map.

    Reviews are counted per (app, pain point) before the join, so an app that holds
    a third of all reviews enters it as a few rows.
    """
    per_app = (reviews.dropna(subset=["pain_point_id"])
               .groupBy("app_id", "pain_point_id").agg(F.count(F.lit(1)).alias("n")))
    counts = (per_app.join(segments.dropna(subset=["cluster_id"]), "app_id")
              .groupBy("cluster_id", "pain_point_id").agg(F.sum("n").alias("review_count")))
    return _shares(counts, min_reviews)


def _shares(counts: DataFrame, min_reviews: int) -> DataFrame:
    totals = counts.groupBy("cluster_id").agg(F.sum("review_count").alias("cluster_negative_reviews"))
    share = round_even(F.col("review_count") / F.col("cluster_negative_reviews"), 3)
    return (lookup_join(counts, totals, "cluster_id")
            .withColumn("pain_point_share", share)
            .withColumn("sufficient_review_coverage", F.col("cluster_negative_reviews") >= min_reviews))


def pain_point_statistics(negatives: DataFrame) -> DataFrame:
    """Reviews, share of all negatives, mean rating and apps per pain point."""
    per_app = negatives.groupBy("pain_point_id", "app_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(to_number(F.col("review_rating"))).alias("rating_sum"),
        F.count(to_number(F.col("review_rating"))).alias("rated"))
    stats = per_app.groupBy("pain_point_id").agg(
        F.sum("n").alias("review_count"), F.sum("rating_sum").alias("rating_sum"),
        F.sum("rated").alias("rated"), F.count("app_id").alias("game_count"))
    total = negatives.agg(F.count(F.lit(1))).scalar()
    return (stats.withColumn("__total", total).select(
        "pain_point_id", "review_count",
        round_even(F.col("review_count") / F.col("__total"), 3).alias("share_of_negative_reviews"),
        round_even(F.col("rating_sum") / F.nullif("rated", F.lit(0)), 2).alias("average_rating"),
        "game_count"))


def representative_reviews(similarity: DataFrame, reviews: DataFrame, key: str,
                           limit: int = 4) -> DataFrame:
    """Reviews nearest to each pain point's centre, clipped and joined by ` || `.

    `similarity` is (key, pain_point_id, similarity). Ranking runs on keys alone;
    only the chosen texts are joined. Values keep 12 digits, ties by key.
    """
    top = top_per_key(similarity.withColumn("__s", F.round("similarity", 12)),
                      ["pain_point_id"], [F.desc("__s"), key], limit)
    chosen = top.select(key, "pain_point_id", "rank").join(reviews.select(key, "review_text"), key)
    return (chosen.groupBy("pain_point_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", clip_example(F.col("review_text")).alias("t")))).alias("e"))
            .select("pain_point_id", F.array_join("e.t", " || ").alias("representative_reviews")))


def coverage_report(games: DataFrame, reviews: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per game: reviews and pages collected and whether a request failed; zeros are kept.

    `pages` is (app_id, pages_collected, request_failed), one row per app.
    """
    counts = reviews.groupBy("app_id").agg(F.count(F.lit(1)).alias("reviews_collected"))
    out = lookup_join(games.select("app_id", "game_title", "developer"), counts, "app_id")
    out = out.withColumn("reviews_collected", F.coalesce("reviews_collected", F.lit(0)))
    if pages is None:
        return out
    return (lookup_join(out, pages.select("app_id", "pages_collected", "request_failed"), "app_id")
            .withColumn("pages_collected", F.coalesce("pages_collected", F.lit(0)))
            .withColumn("request_failed", F.coalesce("request_failed", F.lit(False))))


def rating_bands(reviews: DataFrame, coverage: DataFrame, max_pages: int = 5,
                 page_size: int = 50) -> DataFrame:
    """One row: totals, mean, rating bands, apps, games with and without reviews, failures."""
    rating = F.col("review_rating")
    per_app = reviews.groupBy("app_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(rating).alias("s"), F.count(rating).alias("r"),
        F.count_if(rating <= 2).alias("neg"), F.count_if(rating == 3).alias("neu"),
        F.count_if(rating >= 4).alias("pos"))
    zero = F.lit(0)
    totals = per_app.agg(
        F.coalesce(F.sum("n"), zero).alias("total_reviews"),
        round_even(F.sum("s") / F.nullif(F.sum("r"), zero), 2).alias("average_rating"),
        F.coalesce(F.sum("neg"), zero).alias("negative_reviews"),
        F.coalesce(F.sum("neu"), zero).alias("neutral_reviews"),
        F.coalesce(F.sum("pos"), zero).alias("positive_reviews"),
        F.count("app_id").alias("unique_apps"))
    games = coverage.agg(F.struct(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(F.col("reviews_collected") > 0).alias("with_reviews"),
        F.count_if("request_failed").alias("failed")).alias("g")).scalar()
    return totals.withColumn("g", games).select(
        *totals.columns, F.col("g.requested").alias("games_requested"),
        F.col("g.with_reviews").alias("games_with_reviews"),
        (F.col("g.requested") - F.col("g.with_reviews")).alias("games_without_reviews"),
        F.col("g.failed").alias("games_with_failures"),
        (F.col("g.requested") * max_pages * page_size).alias("theoretical_maximum"))


def top_pain_points(links: DataFrame, summary: DataFrame, limit: int = 3, examples: int = 2) -> DataFrame:
    """Largest shares of each sufficiently covered segment with keywords and examples."""
    usable = links.filter(truth(F.col("sufficient_review_coverage")))
    top = top_per_key(usable, ["cluster_id"], [F.desc("pain_point_share"), "pain_point_id"], limit)
    return (pain_point_details(top, summary)
            .withColumn("example_reviews", F.slice(
                split_list(F.col("representative_reviews"), " || "), 1, examples)))


def pain_point_details(links: DataFrame, summary: DataFrame) -> DataFrame:
    """Links with the pain point's summary; its review_count becomes total_review_count."""
    details = summary.select("pain_point_id", F.col("review_count").alias("total_review_count"),
                             "keywords", "representative_reviews")
    return lookup_join(links, details, "pain_point_id")
