"""From reviews to recurring complaints and their share in each segment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.contracts import require_columns, stored_checked
from segmentry.functions.columns import normalize_id
from segmentry.operators import clusters
from segmentry.operators import reviews as R
from segmentry.operators import tfidf as T
from segmentry.operators.kmeans import KMeansFit
from segmentry.operators.model import TextSegmenter
from segmentry.session import materialize, scratch_path

KEY = "review_key"


@dataclass(frozen=True)
class PainPoints:
    """Labelled negative reviews, summary, links to segments, evaluation, model."""

    reviews: DataFrame
    summary: DataFrame
    links: DataFrame
    evaluation: DataFrame
    model: KMeansFit
    segmenter: TextSegmenter


def pain_point_table(negatives: DataFrame, fitted: T.Fitted, centres: dict[int, np.ndarray] | None = None,
                     key: str = KEY, keywords: int = 10, examples: int = 4) -> DataFrame:
    """Summary per pain point: counts, keywords, representative reviews.

    `negatives` holds key, app_id, review_text, review_rating, pain_point_id; the rows of `fitted` carry
    pain_point_id. Without the model's `centres` the means of the members serve as centres.
    """
    centres = T.member_centres(fitted.entries, fitted.size, "pain_point_id") if centres is None else centres
    near = T.centre_similarity(fitted.entries, centres, key, "pain_point_id")
    return (R.pain_point_statistics(negatives)
            .join(T.cluster_keywords(fitted.weights, fitted.entries, keywords, "pain_point_id"), "pain_point_id", "left")
            .join(R.representative_reviews(near, negatives, key, examples), "pain_point_id", "left"))


def build_pain_points(reviews: DataFrame, clustered: DataFrame, order: Sequence[str | Column],
                      ks: Sequence[int] = range(3, 11), restarts: int = 30, final_restarts: int = 50,
                      min_reviews: int = 20, min_cluster: int = 10,
                      profile: T.Profile = T.REVIEWS) -> PainPoints:
    """Negative reviews -> TF-IDF -> KMeans over k -> complaints -> shares per segment.

    `order` decides which of several equal reviews stays.
    """
    require_columns(reviews, ("app_id", "game_title", "review_text", "review_rating"), "reviews")
    require_columns(clustered, ("app_id", "cluster_id"), "clustered table")
    clean = reviews.withColumns({
        "app_id": normalize_id(F.col("app_id"), strip=False),
        "review_text": F.btrim(F.coalesce("review_text", F.lit("")), F.lit(" \t\n\r\f\u000b"))})
    negatives = R.negative_reviews(clean, order)
    # one row per app and text, so their hash pair names a row
    keyed = negatives.withColumn(KEY, F.sha2(F.concat_ws("\u0001", "app_id", "review_text"), 256))
    negatives = stored_checked(keyed, scratch_path(keyed.sparkSession, "negatives"), {"negative reviews": (None, min_reviews)})
    fitted = T.fit(negatives.select(KEY, "cleaned_review"), KEY, "cleaned_review", profile)
    features = fitted.features()
    evaluation = clusters.sweep_cluster_counts(features, ks, restarts, "cosine", key=KEY)
    chosen = clusters.choose_cluster_count(evaluation, min_cluster).first()["number_of_clusters"]
    model = clusters.fit_kmeans(features, chosen, final_restarts)
    labels = materialize(clusters.label_points(model, features, "pain_point_id"), "labels")
    labelled = materialize(negatives.drop("pain_point_id").join(labels, KEY), "pain-points")
    packed = replace(fitted, entries=materialize(fitted.entries.join(labels, KEY), "labelled-weights"), keep=("pain_point_id",))
    summary = pain_point_table(labelled, packed, dict(enumerate(model.centres)))
    segments = R.segment_map(clustered.withColumn("app_id", normalize_id(F.col("app_id"), strip=False)))
    return PainPoints(R.attach_segments(labelled.drop("cluster_id"), segments), summary,
                      R.segment_pain_points_from_apps(labelled, segments), evaluation, model,
                      TextSegmenter.of(fitted, profile, model))


