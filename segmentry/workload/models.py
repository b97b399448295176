"""Vectors, SVD, KMeans, silhouettes, nearest items and the end-to-end runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions.columns import distance, unit_vector
from segmentry.operators import clusters
from segmentry.operators import tfidf as T
from segmentry.operators.model import TextSegmenter
from segmentry.plans import opportunities, pain_points, segments
from segmentry.session import materialize, scratch_path
from segmentry.streaming import ingest
from segmentry.workload import views as V
from segmentry.workload.text import CORPUS, NEGATIVES, corpus, negatives, sql_tfidf
from segmentry.workload.views import table


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


# ---------------------------------------------------------------- vectors

def row_normalize(spark: SparkSession, folder: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7))
    rows = _embeddings(spark, folder).select("vec_id", unit_vector(scaled).alias("u"))
    return rows.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first_value"),
                       F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square_sum"))


def cluster_silhouette_cosine(spark: SparkSession, folder: str) -> DataFrame:
    scored = clusters.silhouette_cosine(_embeddings(spark, folder), "embedding", "label")
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("points"),
                                       F.round(F.avg("silhouette"), 6).alias("silhouette"))


def cluster_silhouette_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    scored = clusters.silhouette_euclidean(_embeddings(spark, folder), "vec_id", "embedding", "label")
    return scored.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("points"), F.round(F.avg("silhouette"), 6).alias("silhouette"))


def nearest_items(spark: SparkSession, folder: str) -> DataFrame:
    points = _embeddings(spark, folder).withColumn("title", F.concat(F.lit("v"), "vec_id"))
    centres = clusters.mean_vectors(points, "embedding", "label")
    return clusters.nearest_items(points, centres, "embedding", "title", 6, "label", tie=("vec_id",))


# ---------------------------------------------------------------- models

def svd_reduce(spark: SparkSession, folder: str) -> DataFrame:
    docs = corpus(spark, folder).select("doc_id", "cleaned_text")
    fitted = T.fit(docs, "doc_id", "cleaned_text", T.CATALOG)
    reduced, explained = clusters.reduce_dimensions(fitted.entries, "doc_id", fitted.size, 50)
    size = F.aggregate(clusters.vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x)
    return reduced.select("doc_id", F.round(size, 6).alias("square_sum"), F.lit(0 < explained <= 1).alias("explained_in_range"))


def _sweep_facts(points: DataFrame, sweep: DataFrame) -> DataFrame:
    """Per k what must hold of its best fit: sizes that k clusters can have, a silhouette, an inertia below that of one cluster."""
    v = clusters.vector_to_array("features")
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    mean = clusters.Summarizer.mean(F.col("features"))
    total = points.select("features", square.alias("q")).agg(F.count(F.lit(1)).alias("rows"), F.sum("q").alias("q"), mean.alias("features"))
    rows = total.select("rows", (F.col("q") - F.col("rows") * square).alias("spread")).first()
    k = F.col("number_of_clusters")
    return sweep.select(
        k.cast("long").alias("number_of_clusters"), F.lit(rows["rows"]).alias("points"),
        ((F.col("smallest_cluster_size") * k <= rows["rows"]) & (F.col("largest_cluster_size") * k >= rows["rows"])).alias("sizes_fit"),
        F.col("silhouette_score").between(-1, 1).alias("silhouette_fits"),
        ((F.col("inertia") >= 0) & (F.col("inertia") <= rows["spread"] * (1 + 1e-9))).alias("inertia_fits"))


def sweep_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    points = clusters.array_features(_embeddings(spark, folder)).select("vec_id", "features")
    return _sweep_facts(points, clusters.sweep_cluster_counts(points, range(3, 16), metric="cosine"))


def sweep_reviews(spark: SparkSession, folder: str) -> DataFrame:
    docs = negatives(spark, folder).select("doc_id", "cleaned_review")
    points = T.fit(docs, "doc_id", "cleaned_review", T.REVIEWS).features()
    return _sweep_facts(points, clusters.sweep_cluster_counts(points, range(3, 11), metric="cosine"))


def sweep_games(spark: SparkSession, folder: str) -> DataFrame:
    """Games' texts reduced, then every k by the exact euclidean silhouette."""
    docs = corpus(spark, folder).select("doc_id", "cleaned_text")
    fitted = T.fit(docs, "doc_id", "cleaned_text", T.CATALOG)
    features, _ = clusters.project(fitted.entries, "doc_id", clusters.singular_basis(fitted.entries, fitted.size))
    points = materialize(features, "features", features.schema)
    return _sweep_facts(points, clusters.sweep_cluster_counts(points, range(3, 21), metric="euclidean", key="doc_id"))


def cluster_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels by a model that was saved and read back; is_nearest compares with the distances to all its centres."""
    rows = _embeddings(spark, folder).select("vec_id", "embedding")
    points = clusters.array_features(rows)
    path = scratch_path(spark, "kmeans")
    clusters.save_model(clusters.fit_kmeans(points.select("vec_id", "features"), 10), path)
    model = clusters.load_kmeans(path)
    gaps = [distance(F.col("embedding"), F.array(*(F.lit(float(x)) for x in c))) for c in model.centres]
    labelled = clusters.label_points(model, points)
    own = F.get(F.array(*gaps), F.col("cluster_id"))
    return labelled.select("vec_id", (own <= F.least(*gaps) + 1e-9).alias("is_nearest"))


def saved_text_model(spark: SparkSession, folder: str) -> DataFrame:
    """A text model saved, read back and applied to all texts anew: documents, and labels that differ."""
    docs = materialize(corpus(spark, folder).select("doc_id", "cleaned_text"), "corpus")
    fitted = T.fit(docs, "doc_id", "cleaned_text", T.CATALOG)
    features, basis = clusters.project(fitted.entries, "doc_id", clusters.singular_basis(fitted.entries, fitted.size))
    model = clusters.fit_kmeans(features, 8)
    path = scratch_path(spark, "text-model")
    TextSegmenter.of(fitted, T.CATALOG, model, basis).write().overwrite().save(path)
    again = TextSegmenter.load(path).label_new(docs).select("doc_id", F.col("cluster_id").alias("again"))
    both = clusters.label_points(model, features).join(again, "doc_id", "full")
    return both.agg(F.count(F.lit(1)).alias("documents"), F.count_if(~F.col("cluster_id").eqNullSafe(F.col("again"))).alias("differing"))


# ---------------------------------------------------------------- end-to-end runs

def _segments(spark: SparkSession, folder: str) -> segments.Segments:
    return segments.build_segments(V.described(spark, folder), key=("app_id", "chart_type"))


def _segment_facts(summary: DataFrame, ks: range) -> DataFrame:
    """What must hold of any segmentation: every game in one segment, as many segments as were tried, each described."""
    told = (F.col("keywords") != "") & (F.col("representative_games") != "")
    return summary.agg(F.sum("game_count").alias("games"), F.count(F.lit(1)).between(ks[0], ks[-1]).alias("segments_tried"),
                       F.coalesce(F.bool_and(told), F.lit(False)).alias("all_described"))


def segment_build(spark: SparkSession, folder: str) -> DataFrame:
    return _segment_facts(_segments(spark, folder).summary, range(3, 21))


def opportunity_build(spark: SparkSession, folder: str) -> DataFrame:
    built = _segments(spark, folder)
    scores = opportunities.build_opportunities(built.summary, built.clustered)
    n = F.count(F.lit(1))
    return scores.agg(F.sum("game_count").alias("games"), ((F.count_distinct("opportunity_rank") == n) & (F.max("opportunity_rank") == n)
                                                          & (F.min("opportunity_rank") == 1)).alias("ranked"),
                      (F.count_distinct("cluster_name") == n).alias("named"),
                      F.bool_and(F.col("adjusted_opportunity_score").between(0, 100)).alias("scored"))


def embedding_segment_build(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _embeddings(spark, folder).select(F.col("vec_id").cast("string").alias("app_id"), "embedding")
    return _segment_facts(segments.build_embedding_segments(V.described(spark, folder), vectors).summary, range(3, 16))


def pain_point_build(spark: SparkSession, folder: str) -> DataFrame:
    games = V.described(spark, folder).select(F.concat(F.lit("src"), F.col("cluster_id")).alias("app_id"), "cluster_id")
    built = pain_points.build_pain_points(V.reviews(spark, folder), games, ["doc_id"], min_reviews=2)
    reviews = built.reviews.agg(F.count(F.lit(1)).alias("reviews"), F.count_if(F.col("pain_point_id").isNull()).alias("unlabelled"))
    shares = built.links.groupBy("cluster_id").agg(F.sum("pain_point_share").alias("s"), F.sum("review_count").alias("n"))
    totals = shares.agg(F.struct(F.sum("n").alias("linked"), F.bool_and(F.abs(F.col("s") - 1) < 0.01).alias("shares_add_up")).alias("t"))
    told = built.summary.agg(F.struct(F.sum("review_count").alias("summarised"),
                                      F.count(F.lit(1)).between(3, 10).alias("complaints_tried")).alias("t"))
    return reviews.withColumn("links", totals.scalar()).withColumn("told", told.scalar()).select(
        "reviews", "unlabelled", "links.*", "told.*")


def review_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages loaded in resumable steps, then compacted."""
    landed, out, state = (scratch_path(spark, n) for n in ("landed", "batches", "state"))
    V.review_pages(spark, folder).write.parquet(landed)
    ingest.load_reviews(spark, landed, out, state)
    return ingest.compacted(spark, out).groupBy("review_rating").agg(F.count(F.lit(1)).alias("reviews"))


QUERIES = {f.__name__: f for f in (
    row_normalize, cluster_silhouette_cosine, cluster_silhouette_euclidean, nearest_items, svd_reduce,
    sweep_embeddings, sweep_reviews, sweep_games, cluster_labels, saved_text_model, segment_build, opportunity_build, embedding_segment_build,
    pain_point_build, review_ingest)}


# ---------------------------------------------------------------- SQL

_VECTORS = """vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""


def _silhouette(distance: str) -> str:
    return f"""WITH {_VECTORS},
      gaps AS (SELECT a.vec_id, a.label, b.label AS other, sum({distance}) AS s, count(*) AS n
               FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
      ab AS (SELECT vec_id, label, max(CASE WHEN label = other THEN s / n END) AS a,
                    min(CASE WHEN label <> other THEN s / n END) AS b FROM gaps GROUP BY 1, 2)
      SELECT label, count(*) AS points, round(avg(CASE WHEN a IS NULL THEN 0.0
        ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY 1"""


def _sweep_sql(prefix: str, points: str, low: int, high: int) -> str:
    return f"""{prefix} SELECT k AS number_of_clusters, (SELECT count(*) FROM {points}) AS points, TRUE AS sizes_fit,
          TRUE AS silhouette_fits, TRUE AS inertia_fits
        FROM range({low}, {high + 1}) AS r(k) WHERE k <= (SELECT count(*) FROM {points}) - 1"""


SQL = {
    "row_normalize": f"""WITH {_VECTORS}, m AS (SELECT vec_id, vec_id % 7 AS f, v, sqrt(list_inner_product(v, v)) AS len FROM vectors)
        SELECT vec_id, round(CASE WHEN f = 0 THEN 0.0 ELSE v[1] / len END, 6) AS first_value,
               CASE WHEN f = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS square_sum FROM m""",
    "cluster_silhouette_cosine": _silhouette("1.0 - list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))"),
    "cluster_silhouette_euclidean": _silhouette("list_distance(a.v, b.v)"),
    "nearest_items": f"""WITH {_VECTORS},
        dims AS (SELECT label, i, avg(v[i]) AS m FROM vectors, range(1, 65) AS r(i) GROUP BY 1, 2),
        far AS (SELECT a.vec_id, a.label, sqrt(sum((a.v[d.i] - d.m) * (a.v[d.i] - d.m))) AS g
                FROM vectors a JOIN dims d ON a.label = d.label GROUP BY 1, 2),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(g, 9), vec_id) AS r FROM far)
        SELECT label, string_agg('v' || vec_id, ' | ' ORDER BY r) AS representative_games FROM ranked
        WHERE r <= 6 GROUP BY 1""",
    "svd_reduce": f"""WITH {V.DESCRIBED}, {CORPUS}, {sql_tfidf('corpus', 'doc_id', 'cleaned_text', T.CATALOG)}
        SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM tfidf) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS square_sum,
               TRUE AS explained_in_range FROM corpus""",
    "sweep_embeddings": _sweep_sql("", "embeddings", 3, 15),
    "sweep_reviews": _sweep_sql(f"WITH {V.REVIEWS}, {NEGATIVES}", "negatives", 3, 10),
    "sweep_games": _sweep_sql(f"WITH {V.DESCRIBED}, {CORPUS}", "corpus", 3, 20),
    "cluster_labels": "SELECT vec_id, TRUE AS is_nearest FROM embeddings",
    "saved_text_model": f"WITH {V.DESCRIBED}, {CORPUS} SELECT count(*) AS documents, 0::BIGINT AS differing FROM corpus",
    "segment_build": f"WITH {V.DESCRIBED}, {CORPUS} SELECT count(*) AS games, TRUE AS segments_tried, TRUE AS all_described FROM corpus",
    "opportunity_build": f"""WITH {V.DESCRIBED}, {CORPUS}
        SELECT count(*) AS games, TRUE AS ranked, TRUE AS named, TRUE AS scored FROM corpus""",
    "embedding_segment_build": f"""WITH {V.DESCRIBED}, {CORPUS} SELECT count(*) AS games, TRUE AS segments_tried, TRUE AS all_described
        FROM corpus JOIN embeddings ON doc_id = vec_id""",
    "pain_point_build": f"""WITH {V.REVIEWS}, {NEGATIVES}
        SELECT count(*) AS reviews, 0::BIGINT AS unlabelled, count(*) AS linked, TRUE AS shares_add_up, count(*) AS summarised,
               TRUE AS complaints_tried FROM negatives""",
    "review_ingest": f"""WITH {V.REVIEW_LINES}
        SELECT rating AS review_rating, count(*) AS reviews FROM page_entries WHERE rating IS NOT NULL GROUP BY 1""",
}
