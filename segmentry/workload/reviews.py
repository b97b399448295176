"""Review cleaning, links to segments, coverage, rating bands and pain points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions.columns import join_list
from segmentry.operators import reviews as R
from segmentry.operators import tfidf as T
from segmentry.plans.pain_points import pain_point_table
from segmentry.session import materialize
from segmentry.workload import views as V
from segmentry.workload.text import NEGATIVES, negatives, sql_keywords, sql_tfidf


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Negative event reviews with a pain point; some carry none."""
    pain = F.when(F.col("k") % 10 != 0, F.col("k") % 10)
    return V.event_reviews(spark, folder).filter(F.col("review_rating") <= 2).withColumn("pain_point_id", pain)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return R.segment_map(V.event_games(spark, folder))


def _pain_points(spark: SparkSession, folder: str) -> DataFrame:
    """Pain-point summary of the negative document reviews, with keywords and examples."""
    docs = materialize(negatives(spark, folder), "negatives")
    return pain_point_table(docs, T.fit(docs, "doc_id", "cleaned_review", T.REVIEWS, 0, ["pain_point_id"]), key="doc_id")


# ---------------------------------------------------------------- queries

def review_validity(spark: SparkSession, folder: str) -> DataFrame:
    return R.valid_reviews(V.reviews(spark, folder)).select(
        "doc_id", "app_id", "review_rating", F.length("review_text").cast("long").alias("length"))


def review_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return R.dedupe_reviews(R.valid_reviews(V.reviews(spark, folder)), ["doc_id"]).select(
        "doc_id", "app_id", "review_id")


def negative_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return negatives(spark, folder).select("doc_id", "app_id", "cleaned_review")


def review_segments(spark: SparkSession, folder: str) -> DataFrame:
    linked = R.attach_segments(V.event_reviews(spark, folder), _segments(spark, folder), check=True)
    return linked.select("review_key", "app_id", "cluster_id")


def segment_pain_points(spark: SparkSession, folder: str) -> DataFrame:
    return R.segment_pain_points_from_apps(_events(spark, folder), _segments(spark, folder))


def segment_pain_points_linked(spark: SparkSession, folder: str) -> DataFrame:
    return R.segment_pain_points(R.attach_segments(_events(spark, folder), _segments(spark, folder)))


def pain_point_summary(spark: SparkSession, folder: str) -> DataFrame:
    return R.pain_point_statistics(_events(spark, folder).dropna(subset=["pain_point_id"]))


def pain_point_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return _pain_points(spark, folder)


def representative_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return _pain_points(spark, folder).select("pain_point_id", "representative_reviews")


def pain_point_details(spark: SparkSession, folder: str) -> DataFrame:
    return R.pain_point_details(segment_pain_points(spark, folder), _pain_points(spark, folder)).select(
        "cluster_id", "pain_point_id", "review_count", "total_review_count", "keywords")


def top_pain_points(spark: SparkSession, folder: str) -> DataFrame:
    top = R.top_pain_points(segment_pain_points(spark, folder), _pain_points(spark, folder))
    return top.select("cluster_id", "rank", "pain_point_id", "pain_point_share", "keywords",
                      join_list(F.col("example_reviews")).alias("examples"))


def coverage_report(spark: SparkSession, folder: str) -> DataFrame:
    games, events = V.event_games(spark, folder), V.event_reviews(spark, folder)
    pages = events.groupBy("app_id").agg(
        F.max(F.col("k") % 6).cast("long").alias("pages_collected"), F.bool_or(F.col("k") == 7).alias("request_failed"))
    return R.coverage_report(games, events, pages)


def rating_bands(spark: SparkSession, folder: str) -> DataFrame:
    return R.rating_bands(V.event_reviews(spark, folder), coverage_report(spark, folder))


QUERIES = {f.__name__: f for f in (
    review_validity, review_dedupe, negative_reviews, review_segments, segment_pain_points,
    segment_pain_points_linked, pain_point_summary, pain_point_evidence, representative_reviews,
    pain_point_details, top_pain_points, coverage_report, rating_bands)}


# ---------------------------------------------------------------- SQL

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
VALID = f"""valid AS (SELECT * EXCLUDE (review_text, review_rating), trim(review_text, {_BLANKS}) AS review_text,
    TRY_CAST(review_rating AS DOUBLE) AS review_rating FROM reviews
  WHERE TRY_CAST(review_rating AS DOUBLE) BETWEEN 1 AND 5 AND length(trim(review_text, {_BLANKS})) >= 5)"""
EVENT_LINKS = f"""{V.EVENT_REVIEWS}, {V.EVENT_GAMES},
  bad AS (SELECT *, CASE WHEN k % 10 <> 0 THEN k % 10 END AS pain_point_id FROM event_reviews WHERE review_rating <= 2),
  counts AS (SELECT cluster_id, pain_point_id, count(*) AS review_count
             FROM bad JOIN event_games g ON bad.app_id = g.app_id WHERE pain_point_id IS NOT NULL GROUP BY 1, 2),
  links AS (SELECT *, sum(review_count) OVER (PARTITION BY cluster_id)::BIGINT AS cluster_negative_reviews,
      round_even(review_count / sum(review_count) OVER (PARTITION BY cluster_id) * 1000, 0) / 1000 AS pain_point_share,
      sum(review_count) OVER (PARTITION BY cluster_id) >= 8 AS sufficient_review_coverage FROM counts)"""
PAIN_POINTS = f"""{V.REVIEWS}, {NEGATIVES},
  {sql_tfidf('negatives', 'doc_id', 'cleaned_review', T.REVIEWS, 'pain_point_id')},
  {sql_keywords('negatives', 'doc_id', 'pain_point_id', 10)},
  centre AS (SELECT t.pain_point_id, term, sum(weight) / any_value(n) AS m FROM tfidf t
    JOIN (SELECT pain_point_id, count(*) AS n FROM negatives GROUP BY 1) s ON t.pain_point_id = s.pain_point_id
    GROUP BY 1, 2),
  lens AS (SELECT pain_point_id, sqrt(sum(m * m)) AS len FROM centre GROUP BY 1),
  cosines AS (SELECT t.doc_id, sum(weight * m) / (sqrt(sum(weight * weight)) * any_value(len)) AS c FROM tfidf t
    JOIN centre c ON t.pain_point_id = c.pain_point_id AND t.term = c.term
    JOIN lens l ON t.pain_point_id = l.pain_point_id GROUP BY 1),
  near AS (SELECT n.pain_point_id, n.review_text, row_number() OVER (
      PARTITION BY n.pain_point_id ORDER BY round(coalesce(c, 0.0), 12) DESC, n.doc_id) AS r
    FROM negatives n LEFT JOIN cosines c ON n.doc_id = c.doc_id),
  examples AS (SELECT pain_point_id, string_agg(CASE WHEN length(t) > 250 THEN substr(t, 1, 247) || '...' ELSE t END,
      ' || ' ORDER BY r) AS representative_reviews
    FROM (SELECT *, replace(review_text, chr(10), ' ') AS t FROM near WHERE r <= 4) GROUP BY 1),
  pains AS (SELECT n.pain_point_id, count(*) AS review_count,
      round_even(count(*) / (SELECT count(*) FROM negatives) * 1000, 0) / 1000 AS share_of_negative_reviews,
      round_even(avg(CAST(review_rating AS DOUBLE)) * 100, 0) / 100 AS average_rating,
      count(DISTINCT app_id) AS game_count FROM negatives n GROUP BY 1),
  evidence AS (SELECT p.*, k.keywords, e.representative_reviews FROM pains p
    LEFT JOIN keywords k ON p.pain_point_id = k.pain_point_id
    LEFT JOIN examples e ON p.pain_point_id = e.pain_point_id)"""
TOP_PAINS = f"""{EVENT_LINKS}, {PAIN_POINTS},
  top_links AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id
      ORDER BY pain_point_share DESC, pain_point_id) AS INTEGER) AS rank FROM links WHERE sufficient_review_coverage),
  top_pains AS (SELECT l.cluster_id, l.rank, l.pain_point_id, l.pain_point_share, e.keywords,
      list_filter(list_transform(string_split(coalesce(e.representative_reviews, ''), ' || '), lambda x: trim(x)),
                  lambda x: x <> '')[1:2] AS examples
    FROM top_links l LEFT JOIN evidence e ON l.pain_point_id = e.pain_point_id WHERE l.rank <= 3)"""
COVERAGE = f"""{V.EVENT_REVIEWS}, {V.EVENT_GAMES},
  coverage AS (SELECT g.app_id, game_title, developer, count(review_key) AS reviews_collected,
      coalesce(max(k % 6), 0)::BIGINT AS pages_collected, coalesce(bool_or(k = 7), false) AS request_failed
    FROM event_games g LEFT JOIN event_reviews r ON g.app_id = r.app_id GROUP BY 1, 2, 3)"""

SQL = {
    "review_validity": f"""WITH {V.REVIEWS}, {VALID}
        SELECT doc_id, app_id, review_rating, length(review_text) AS length FROM valid""",
    "review_dedupe": f"""WITH {V.REVIEWS}, {VALID}
        SELECT doc_id, app_id, review_id FROM (SELECT *, row_number() OVER (
          PARTITION BY app_id, coalesce(review_id, ''), review_text ORDER BY doc_id) AS n FROM valid) WHERE n = 1""",
    "negative_reviews": f"WITH {V.REVIEWS}, {NEGATIVES} SELECT doc_id, app_id, cleaned_review FROM negatives",
    "review_segments": f"""WITH {V.EVENT_REVIEWS}, {V.EVENT_GAMES}
        SELECT review_key, r.app_id, cluster_id FROM event_reviews r LEFT JOIN event_games g ON r.app_id = g.app_id""",
    "segment_pain_points": f"WITH {EVENT_LINKS} SELECT * FROM links",
    "segment_pain_points_linked": f"WITH {EVENT_LINKS} SELECT * FROM links",
    "pain_point_summary": f"""WITH {EVENT_LINKS}, p AS (SELECT * FROM bad WHERE pain_point_id IS NOT NULL)
        SELECT pain_point_id, count(*) AS review_count,
               round_even(count(*) / (SELECT count(*) FROM p) * 1000, 0) / 1000 AS share_of_negative_reviews,
               round_even(avg(review_rating) * 100, 0) / 100 AS average_rating, count(DISTINCT app_id) AS game_count
        FROM p GROUP BY 1""",
    "pain_point_evidence": f"WITH {PAIN_POINTS} SELECT * FROM evidence",
    "representative_reviews": f"WITH {PAIN_POINTS} SELECT pain_point_id, representative_reviews FROM evidence",
    "pain_point_details": f"""WITH {EVENT_LINKS}, {PAIN_POINTS}
        SELECT l.cluster_id, l.pain_point_id, l.review_count, e.review_count AS total_review_count, e.keywords
        FROM links l LEFT JOIN evidence e ON l.pain_point_id = e.pain_point_id""",
    "top_pain_points": f"""WITH {TOP_PAINS}
        SELECT cluster_id, rank, pain_point_id, pain_point_share, keywords,
               array_to_string(examples, ' | ') AS examples FROM top_pains""",
    "coverage_report": f"WITH {COVERAGE} SELECT * FROM coverage",
    "rating_bands": f"""WITH {COVERAGE}
        SELECT count(*) AS total_reviews, round_even(avg(review_rating) * 100, 0) / 100 AS average_rating,
               count(*) FILTER (WHERE review_rating <= 2) AS negative_reviews,
               count(*) FILTER (WHERE review_rating = 3) AS neutral_reviews,
               count(*) FILTER (WHERE review_rating >= 4) AS positive_reviews, count(DISTINCT app_id) AS unique_apps,
               (SELECT count(*) FROM coverage) AS games_requested,
               (SELECT count(*) FROM coverage WHERE reviews_collected > 0) AS games_with_reviews,
               (SELECT count(*) FROM coverage WHERE reviews_collected = 0) AS games_without_reviews,
               (SELECT count(*) FROM coverage WHERE request_failed) AS games_with_failures,
               (SELECT count(*) * 250 FROM coverage) AS theoretical_maximum
        FROM event_reviews""",
}
