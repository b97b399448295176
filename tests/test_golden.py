"""Published results of a real catalog: 19 segments, 9 complaints, choices of k."""

import pytest
from pyspark.sql import functions as F

from segmentry.functions import constants as K
from segmentry.operators import clusters, reviews, scoring

# id games devs rating median position share coherence | MS PV CG DD SC CF | level type score adjusted rank
SEGMENTS = """
0 12 10 4.691 14814 56.5 0.166667 0.491 12.6 14.1 5.9 12.5 4.7 8.0 Medium cand 57.8 57.8 8
1 19 18 4.569 15967 43.21 0.105263 0.331 20.2 12.5 0.0 13.4 0.0 10.0 High cand 56.1 56.1 10
2 12 11 4.734 4136 52.67 0.166667 0.408 14.8 13.7 5.5 12.5 2.2 8.0 Medium cand 56.8 56.8 9
3 6 6 4.725 19180 44.83 0.166667 0.562 19.2 14.8 9.9 12.5 6.7 4.0 Low cand 67.2 67.2 3
4 7 1 4.588 11241 34.71 1.0 0.768 25.0 12.5 2.6 0.0 12.8 4.7 Low fran 57.6 42.6 14
5 12 11 4.655 6963 47.5 0.166667 0.402 17.7 13.0 5.5 12.5 2.1 8.0 Medium cand 58.9 58.9 6
6 15 10 4.687 35584 51.53 0.4 0.394 15.4 14.8 3.6 9.0 1.8 10.0 High cand 54.6 54.6 11
7 8 1 4.553 607 59.25 1.0 0.845 11.0 9.8 2.5 0.0 15.0 5.3 Low fran 43.6 28.6 16
8 16 16 4.475 56184 45.0 0.0625 0.35 19.1 12.3 2.2 14.1 0.6 10.0 High cand 58.3 58.3 7
9 13 12 4.816 352722 44.0 0.153846 0.45 19.7 18.3 4.8 12.7 3.5 8.7 Medium cand 67.7 67.7 2
10 6 6 4.727 28502 43.0 0.166667 0.58 20.3 15.1 9.9 12.5 7.3 4.0 Low cand 69.1 69.1 1
11 5 1 4.001 419 46.0 1.0 0.817 18.6 2.1 2.8 0.0 14.2 3.3 Low fran 41.0 26.0 18
12 17 13 4.618 12698 60.18 0.176471 0.331 10.5 13.0 2.6 12.4 0.0 10.0 High cand 48.5 48.5 12
13 10 7 3.848 3371 53.3 0.2 0.461 14.4 1.6 7.6 12.0 3.8 6.7 Medium cand 46.1 46.1 13
14 5 3 4.524 1427 63.2 0.6 0.601 8.8 10.0 6.9 6.0 7.9 3.3 Low fran 42.9 27.9 17
15 3 1 4.345 16664 50.33 1.0 0.775 16.1 9.6 3.0 0.0 13.0 2.0 Low fran 43.7 28.7 15
16 13 9 4.693 98232 49.38 0.153846 0.388 16.7 15.6 5.8 12.7 1.7 8.7 Medium cand 61.2 61.2 4
17 17 14 4.754 311929 50.53 0.117647 0.394 16.0 17.4 2.4 13.2 1.8 10.0 High cand 60.8 60.8 5
18 3 1 4.689 3075583 78.67 1.0 0.839 0.0 18.3 3.0 0.0 14.8 2.0 Low fran 38.1 23.1 19
"""
KINDS = {"cand": K.CANDIDATE_TYPE, "fran": K.FRANCHISE_TYPE}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [line.split() for line in SEGMENTS.split("\n") if line]
    inputs = [(int(r[0]), int(r[1]), int(r[2]), *map(float, r[3:8]), "a", "b") for r in rows]
    summary = spark.createDataFrame(
        inputs, "cluster_id int, game_count long, developer_count long, average_rating double, "
                "median_rating_count double, average_chart_position double, top_developer_share double, "
                "semantic_coherence double, keywords string, representative_games string")
    return rows, {r["cluster_id"]: r for r in scoring.opportunity_scores(summary).collect()}


def test_components_labels_and_rank(scored):
    rows, out = scored
    exact = 0
    for r in rows:
        row = out[int(r[0])]
        assert [row[c] for c in scoring.SCORE_COLUMNS] == [float(x) for x in r[8:14]], r[0]
        assert (row["confidence_level"], row["segment_type"]) == (r[14], KINDS[r[15]])
        # the stored coherence has three digits, so totals may be off by one step
        assert row["opportunity_score"] == pytest.approx(float(r[16]), abs=0.1001)
        exact += row["opportunity_score"] == float(r[16])
        assert row["ranking_penalty"] == (15.0 if r[15] == "fran" else 0.0)
    assert exact == 15
    assert sorted(r["opportunity_rank"] for r in out.values()) == list(range(1, 20))


def test_rank_of_published_scores(spark, scored):
    rows, _ = scored
    table = spark.createDataFrame([(int(r[0]), float(r[17])) for r in rows],
                                  "cluster_id int, adjusted_opportunity_score double")
    ranks = {r["cluster_id"]: r["opportunity_rank"] for r in scoring.rank_segments(table).collect()}
    assert ranks == {int(r[0]): int(r[18]) for r in rows}


def test_choice_of_k(spark):
    games = "0.066428 0.087736 0.098102 0.101411 0.115164 0.103945 0.129308 0.115420 0.139530 0.141797 0.150110 " \
            "0.149703 0.156565 0.157803 0.159072 0.170371 0.181482 0.177193"
    rows = [(k, float(s)) for k, s in enumerate(games.split(), 3)]
    table = spark.createDataFrame(rows, "number_of_clusters int, silhouette_score double")
    assert clusters.choose_cluster_count(table).first()[0] == 19
    reviews_k = [(3, 0.009101, 381), (4, 0.010317, 72), (5, 0.010410, 82), (6, 0.009588, 133),
                 (7, 0.011477, 91), (8, 0.010931, 109), (9, 0.012808, 43), (10, 0.012962, 64)]
    sized = spark.createDataFrame(reviews_k, "number_of_clusters int, silhouette_score double, smallest_cluster_size int")
    assert clusters.choose_cluster_count(sized, 10).first()[0] == 9
    # no k is large enough: all compete
    assert clusters.choose_cluster_count(sized, 1000).first()[0] == 9
    small = sized.withColumn("smallest_cluster_size", F.when(F.col("number_of_clusters") == 9, 1).otherwise(50))
    assert clusters.choose_cluster_count(small, 10).first()[0] == 10


def test_complaint_shares(spark):
    sizes = {0: 127, 1: 267, 2: 348, 3: 149, 4: 219, 5: 154, 6: 1290, 7: 134, 8: 43}
    negatives = spark.createDataFrame(
        [(p, f"a{i % 5}", 1.0) for p, n in sizes.items() for i in range(n)],
        "pain_point_id int, app_id string, review_rating double")
    out = {r["pain_point_id"]: r for r in reviews.pain_point_statistics(negatives).collect()}
    shares = {0: .047, 1: .098, 2: .127, 3: .055, 4: .08, 5: .056, 6: .472, 7: .049, 8: .016}
    assert {p: r["share_of_negative_reviews"] for p, r in out.items()} == shares
    assert all(r["game_count"] == 5 and r["average_rating"] == 1.0 for r in out.values())


def test_segment_shares(spark):
    counts = {6: 78, 1: 76, 5: 24, 0: 18, 3: 15, 4: 2, 2: 1, 7: 1}
    linked = spark.createDataFrame([(0, p) for p, n in counts.items() for _ in range(n)] + [(None, 6), (1, 2)],
                                   "cluster_id int, pain_point_id int")
    out = {(r["cluster_id"], r["pain_point_id"]): r for r in reviews.segment_pain_points(linked).collect()}
    shares = {6: .363, 1: .353, 5: .112, 0: .084, 3: .07, 4: .009, 2: .005, 7: .005}
    assert {p: r["pain_point_share"] for (c, p), r in out.items() if c == 0} == shares
    assert out[0, 6]["cluster_negative_reviews"] == 215 and out[0, 6]["sufficient_review_coverage"]
    assert not out[1, 2]["sufficient_review_coverage"]
