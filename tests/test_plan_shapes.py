"""Plans that must hold at scale: what is pruned, cut before shuffles, never gathered."""

import pytest
from pyspark.sql import functions as F

from segmentry.operators import market, reviews, rows, scoring
from segmentry.operators import tfidf as T
from segmentry.workload import views as V
from segmentry.workload.text import corpus


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_per_key_is_cut_before_the_shuffle(spark, folder):
    text = plan(rows.first_per_key(V.charts(spark, folder), ["app_id"], ["entry", "seller"]))
    assert "Partial" in text[text.index("WindowGroupLimit"):] and text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("build", [
    lambda s, f: reviews.negative_reviews(V.reviews(s, f), ["doc_id"]),
    lambda s, f: reviews.dedupe_reviews(V.reviews(s, f), ["doc_id"]),
    lambda s, f: scoring.representative_games(V.charts(s, f)),
    lambda s, f: T.cluster_keywords(T.tfidf(corpus(s, f), "doc_id", "cleaned_text", extra=["cluster_id"]), corpus(s, f)),
])
def test_group_limits(build, spark, folder):
    assert "Partial" in plan(build(spark, folder)) and "WindowGroupLimit" in plan(build(spark, folder))


def test_columns_and_filters_reach_the_scan(spark, folder):
    text = plan(market.segment_members(V.charts(spark, folder), 3).select("app_id", "chart_position"))
    assert "EqualTo(p_size,3)" in text and "l_extendedprice" not in text and "l_quantity" not in text


def test_no_cartesian_product(spark, folder):
    for df in (market.market_metrics(V.charts(spark, folder)), scoring.segment_statistics(V.charts(spark, folder)),
               T.tfidf(corpus(spark, folder), "doc_id", "cleaned_text"),
               reviews.pain_point_statistics(V.reviews(spark, folder))):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_terms_of_a_document_are_not_shuffled(spark, folder):
    docs = corpus(spark, folder).select("doc_id", "cleaned_text")
    text = plan(T.term_counts(docs, "doc_id", "cleaned_text", T.CATALOG))
    assert "Exchange" not in text


def test_hot_app_enters_the_join_as_few_rows(spark):
    hot = spark.range(30000).select(
        F.when(F.col("id") < 20000, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 500)).alias("app_id"),
        (F.col("id") % 9).alias("pain_point_id"))
    apps = hot.select("app_id").distinct().withColumn("cluster_id", F.length("app_id"))
    out = reviews.segment_pain_points_from_apps(hot, apps)
    assert out.agg(F.sum("review_count")).first()[0] == 30000
    assert out.filter("cluster_id = 3").agg(F.sum("review_count")).first()[0] >= 20000
