"""Vectors and models against brute force; invariants of the end-to-end runs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segmentry import workload
from segmentry.operators import clusters
from segmentry.operators import tfidf as T
from segmentry.plans import opportunities, pain_points, segments
from segmentry.workload import views as V


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(1)
    dense = rng.random((60, 30)) * (rng.random((60, 30)) < 0.2)
    dense[5] = 0
    rows = [(i, [int(c) for c in np.flatnonzero(x)], [float(v) for v in x[x != 0]]) for i, x in enumerate(dense)]
    return dense, spark.createDataFrame(rows, "id long, indices array<int>, values array<double>").repartition(3)


def test_gram_product(sparse):
    dense, entries = sparse
    basis = np.random.default_rng(2).random((30, 4))
    assert np.allclose(clusters.gram_product(entries, basis), dense.T @ (dense @ basis))


def test_singular_vectors_span_the_leading_space(sparse):
    dense, entries = sparse
    found = clusters.singular_vectors(entries, 30, 3, passes=20)
    exact = np.linalg.svd(dense)[2][:3].T
    assert np.allclose(np.abs((found * exact).sum(axis=0)), 1.0, atol=1e-6)


def test_reduced_rows(sparse):
    dense, entries = sparse
    reduced, share = clusters.reduce_dimensions(entries, "id", 30, 5)
    rows = {r["id"]: np.array(r["features"].toArray()) for r in reduced.collect()}
    lengths = [np.linalg.norm(v) for i, v in rows.items() if i != 5]
    assert len(rows) == 60 and np.allclose(lengths, 1.0) and np.allclose(rows[5], 0.0)
    projected = dense @ np.linalg.svd(dense)[2][:5].T
    assert share == pytest.approx(projected.var(axis=0).sum() / dense.var(axis=0).sum(), abs=0.02)


def test_sparse_vectors(sparse):
    dense, entries = sparse
    rows = T.to_vectors(entries, "id", 30).collect()
    assert all(np.allclose(r["features"].toArray(), dense[r["id"]]) for r in rows)


def test_silhouettes_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.random((90, 4))
    labels = rng.integers(0, 3, 90)
    labels[0] = 7  # a cluster of one
    points = spark.createDataFrame([(i, [float(v) for v in x[i]], int(labels[i])) for i in range(90)],
                                   "id long, v array<double>, c int")

    def brute(gap):
        out = {}
        for i in range(90):
            means = {c: gap[i][(labels == c) & (np.arange(90) != i)].mean() for c in set(labels)
                     if ((labels == c) & (np.arange(90) != i)).any()}
            own = means.pop(labels[i], None)
            near = min(means.values())
            out[i] = 0.0 if own is None else (near - own) / max(own, near)
        return out

    euclid = brute(np.linalg.norm(x[:, None] - x[None], axis=2))
    blocks = {r["id"]: r["silhouette"] for r in clusters.silhouette_euclidean(points, "id", "v", "c", block_rows=20).collect()}
    assert blocks == pytest.approx(euclid, abs=1e-6)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linear = {r["id"]: r["silhouette"] for r in clusters.silhouette_cosine(points, "v", "c").collect()}
    assert linear == pytest.approx(brute(1 - unit @ unit.T), abs=1e-9)


def test_kmeans_finds_clear_groups_and_is_saved(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0], [9, 0], [0, 9]])
    rows = [(i, [float(v) for v in centres[i % 3] + rng.normal(0, .1, 2)]) for i in range(60)]
    points = clusters.array_features(spark.createDataFrame(rows, "id int, embedding array<double>"))
    evaluation = clusters.sweep_cluster_counts(points.select("id", "features"), [2, 3, 4, 99], 3, "squaredEuclidean")
    assert [r["number_of_clusters"] for r in evaluation.collect()] == [2, 3, 4]
    assert clusters.choose_cluster_count(evaluation).first()[0] == 3
    exact = clusters.sweep_cluster_counts(points.select("id", "features"), [3], 3, "euclidean", key="id").first()
    assert exact["silhouette_score"] > 0.95 and exact["smallest_cluster_size"] == 20
    model = clusters.fit_kmeans(points.cache(), 3, 3)
    clusters.save_model(model, str(tmp_path / "m"))
    labels = clusters.label_points(clusters.load_kmeans(str(tmp_path / "m")), points).collect()
    assert len({(r["id"] % 3, r["cluster_id"]) for r in labels}) == 3


def test_segment_and_opportunity_runs(spark, folder):
    built = segments.build_segments(V.described(spark, folder), range(3, 6), 1, 1, 10)
    clustered, summary = built.clustered, built.summary.collect()
    assert sum(r["game_count"] for r in summary) == clustered.count()
    assert all(r["keywords"] and r["representative_games"] for r in summary)
    assert 0 < built.explained_variance <= 1
    scores = opportunities.build_opportunities(built.summary, clustered).collect()
    assert sorted(r["opportunity_rank"] for r in scores) == list(range(1, len(summary) + 1))
    assert all(0 <= r["adjusted_opportunity_score"] <= 100 for r in scores)
    assert len({r["cluster_name"] for r in scores}) == len(scores)


def test_embedding_segment_run(spark, folder):
    vectors = V.table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("app_id"), "embedding")
    built = segments.build_embedding_segments(V.described(spark, folder), vectors, range(3, 5), 1, 1)
    assert all(r["top_developer_share"] > 0 and r["representative_games"] for r in built.summary.collect())


def test_pain_point_run(spark, folder):
    games = V.described(spark, folder).select(F.concat(F.lit("src"), "cluster_id").alias("app_id"), "cluster_id")
    built = pain_points.build_pain_points(V.reviews(spark, folder), games, ["doc_id"], range(3, 5), 1, 1, min_reviews=2)
    n = built.reviews.count()
    assert built.reviews.filter("pain_point_id is null or cluster_id is null").count() == 0
    assert built.summary.agg(F.sum("review_count")).first()[0] == n
    shares = built.links.groupBy("cluster_id").agg(F.sum("pain_point_share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 0.01 for r in shares)
    with pytest.raises(ValueError, match="too few usable negative reviews"):
        pain_points.build_pain_points(V.reviews(spark, folder), games, ["doc_id"], min_reviews=10 ** 6)


@pytest.mark.parametrize("name", ["sweep_embeddings", "cluster_labels"])
def test_queries_without_sql(name, spark, folder):
    assert workload.queries()[name](spark, folder).count() > 0


@pytest.mark.parametrize("name,swept,restarts,final", [
    ("sweep_embeddings", range(3, 16), 20, None), ("sweep_reviews", range(3, 11), 20, None), ("cluster_labels", [10], None, 20),
    ("segment_build", range(3, 21), 20, 30), ("opportunity_build", range(3, 21), 20, 30),
    ("embedding_segment_build", range(3, 16), 30, 50), ("pain_point_build", range(3, 11), 30, 50)])
def test_queries_run_the_whole_search(name, swept, restarts, final, spark, folder, monkeypatch):
    asked, fit = [], clusters._fit_all

    def one_fit(features, ks, restarts, *rest):
        asked.append((list(ks), restarts))
        return fit(features, ks, 1, *rest)

    monkeypatch.setattr(clusters, "_fit_all", one_fit)
    workload.queries()[name](spark, folder)
    if restarts:
        assert asked[0] == (list(swept), restarts)
    if final:
        assert asked[-1][1] == final and len(asked[-1][0]) == 1


def test_entry(spark):
    import __spark_entry__ as registry
    assert registry.entry(spark).count() > 0


def test_resumed_loading_adds_nothing(spark, folder, tmp_path):
    from segmentry.streaming import ingest
    landed, out, state = (str(tmp_path / n) for n in ("landed", "out", "state"))
    V.review_pages(spark, folder).repartition(3).write.parquet(landed)
    ingest.load_reviews(spark, landed, out, state, files_per_step=1)
    first = ingest.compacted(spark, out).count()
    ingest.load_reviews(spark, landed, out, state, files_per_step=1)
    assert first > 0 and ingest.compacted(spark, out).count() == first
    V.review_pages(spark, folder).write.mode("append").parquet(landed)
    ingest.load_reviews(spark, landed, out, state)
    assert ingest.compacted(spark, out).count() == 2 * first


def test_all_fits_together_equal_spark_from_the_same_starts(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.linalg import Vectors
    from pyspark.mllib.clustering import KMeans, KMeansModel
    from pyspark.mllib.linalg import Vectors as Old

    from segmentry.operators import kmeans

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (40, 4)) for c in rng.normal(0, 3, (5, 4))])
    x[5, 1] = 0
    vectors = [Vectors.dense(v) if i % 2 else Vectors.sparse(4, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(list(enumerate(vectors)), ["id", "features"]).repartition(5)
    rows, size = kmeans.kept_rows(df)
    begun = kmeans.starts(rows, size, [(k, s) for k in (3, 5) for s in range(3)])
    assert [len(m.centres) for m in begun] == [3] * 3 + [5] * 3
    assert all((np.abs(x - c).sum(axis=1) < 1e-12).any() for m in begun for c in m.centres)
    fits = kmeans.advance(rows, begun, size)
    old = spark.sparkContext.parallelize([Old.dense(v) for v in x], 3).cache()
    for start, fit in zip(begun, fits):
        spark_fit = KMeans.train(old, fit.k, 300, initialModel=KMeansModel([Old.dense(c) for c in start.centres]), epsilon=1e-4)
        assert np.allclose(np.array(spark_fit.clusterCenters), fit.centres, atol=1e-6)
        assert spark_fit.computeCost(old) == pytest.approx(fit.cost) and sum(fit.sizes) == len(x)
    for metric in ("cosine", "squaredEuclidean"):
        mine = kmeans.silhouettes(rows, size, fits[2:4], metric)
        for fit, score in zip(fits[2:4], mine):
            labelled = kmeans.labelled(df, fit, "prediction").join(df, "id")
            theirs = ClusteringEvaluator(distanceMeasure=metric).evaluate(labelled)
            assert score == pytest.approx(theirs, abs=1e-9)


def test_jobs_do_not_grow_with_restarts(spark, monkeypatch):
    from segmentry.operators import kmeans

    rng = np.random.default_rng(1)
    points = clusters.array_features(spark.createDataFrame(
        [(i, [float(v) for v in rng.normal(8 * (i % 3), 0.2, 2)]) for i in range(90)], "id int, embedding array<double>"))
    calls, one = [], kmeans._pass
    monkeypatch.setattr(kmeans, "_pass", lambda rows, models, *rest: calls.append(len(models)) or one(rows, models, *rest))
    clusters.fit_kmeans(points.select("id", "features"), 3, 2, max_iter=4)
    few = len(calls)
    clusters.fit_kmeans(points.select("id", "features"), 3, 40, max_iter=4)
    assert len(calls) - few <= 5 and max(calls) == 40


def test_equal_rows_leave_clusters_empty(spark):
    points = clusters.array_features(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id int, embedding array<double>"))
    model = clusters.fit_kmeans(points.select("id", "features"), 3, 2)
    assert model.cost == 0.0 and sorted(model.sizes) == [0, 0, 9]


def test_bounds_keep_far_clusters_apart(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal([c ** 2 * 10, c], 1.0, (60, 2)) for c in range(8)])
    points = spark.createDataFrame([(i, [float(v) for v in x[i]], i // 60) for i in range(480)], "id long, v array<double>, c long")
    placed = clusters._placed(points, clusters._cluster_bounds(points), 15)
    blocks = placed.select("b").distinct().count()
    pairs = clusters.block_pairs(placed)
    copies = pairs.filter("i <> j").count() * 2 / blocks + 1  # of a block, on average
    assert blocks == 32 and copies <= 0.4 * blocks
    labels = np.repeat(np.arange(8), 60)
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    got = {r["id"]: r["silhouette"] for r in clusters.silhouette_euclidean(points, "id", "v", "c", 15).collect()}
    for i in range(480):
        mean = [gap[i][(labels == c) & (np.arange(480) != i)].mean() for c in range(8)]
        own = mean.pop(labels[i])
        assert got[i] == pytest.approx((min(mean) - own) / max(own, min(mean)), abs=1e-7)


@pytest.mark.parametrize("reduced", [True, False])
def test_saved_text_model_labels_the_same(spark, folder, tmp_path, reduced):
    from segmentry.operators.model import TextSegmenter
    from segmentry.workload.text import corpus

    docs = corpus(spark, folder).select("doc_id", "cleaned_text").persist()
    fitted = T.fit(docs, "doc_id", "cleaned_text", T.CATALOG)
    features, basis = (clusters.project(fitted.entries, "doc_id", clusters.singular_basis(fitted.entries, fitted.size, 10))
                       if reduced else (fitted.features(), None))
    model = clusters.fit_kmeans(features, 4, 2)
    whole = TextSegmenter.of(fitted, T.CATALOG, model, basis)
    whole.write().overwrite().save(str(tmp_path / "model"))
    again = TextSegmenter.load(str(tmp_path / "model"))
    labels = {r[0]: r[1] for r in clusters.label_points(model, features).collect()}
    assert {r["doc_id"]: r["cluster_id"] for r in again.label_new(docs.withColumn("note", F.lit("x"))).collect()} == labels
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "unseen words only")], "doc_id long, cleaned_text string")
    assert len({r["cluster_id"] for r in again.transform(odd).collect()}) == 1 and again.transform(odd.limit(0)).count() == 0


def test_passes_spread_over_all_cores_whatever_the_input_partitions(spark):
    """Rows that come in one partition are dealt to all cores; tasks with large centres share the models instead."""
    from segmentry.operators import kmeans

    rng = np.random.default_rng(6)
    x = rng.random((3000, 3))
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, embedding array<double>")
    rows, size = kmeans.kept_rows(clusters.array_features(points.coalesce(1)).select("id", "features"))
    assert size == 3 and rows.rdd.getNumPartitions() >= 4
    models = [kmeans.KMeansFit(x[:k] + s) for k in (2, 3) for s in range(3)]
    few, shares = kmeans._spread(rows, models, kmeans.PART_VALUES)
    assert len(shares) > 1 and sorted(m for share in shares for m in share) == list(range(6))
    moved = kmeans._pass(rows, models, size, True)
    for model, (centres, counts, cost) in zip(models, moved):
        gap = ((x[:, None] - model.centres) ** 2).sum(axis=2)
        own = gap.argmin(axis=1)
        assert counts.tolist() == np.bincount(own, minlength=model.k).tolist() and cost == pytest.approx(gap.min(axis=1).sum())
        assert all(np.allclose(centres[j], x[own == j].mean(axis=0) if (own == j).any() else model.centres[j]) for j in range(model.k))


def test_sparse_rows_are_placed_and_added_as_dense_ones():
    from segmentry.operators import kmeans

    rng = np.random.default_rng(7)
    x = rng.random((40, 90)) * (rng.random((40, 90)) < 0.05)
    x[3] = 0
    row, column = np.nonzero(x)
    ids = np.arange(40, dtype=np.uint64)
    thin = kmeans.Rows(ids, np.bincount(row, minlength=40).astype(np.int32), column.astype(np.int32), x[row, column], 90)
    full = kmeans.Rows(ids, np.zeros(0, np.int32), np.zeros(0, np.int32), x.ravel(), 90)
    assert thin.sparse and not full.sparse and np.array_equal(thin.dense(), x)
    near = kmeans.Nearest(kmeans._groups(range(4), [kmeans.KMeansFit(rng.random((k, 90)) / 9) for k in (3, 5, 3, 5)]), 90)
    for (place, gap), (other, square), (_, centres, half) in zip(near.places(thin), near.places(full), near.groups):
        assert np.array_equal(place, other) and np.allclose(gap, square)
        sums = []
        for rows in (thin, full):
            counts, total = np.zeros(half.shape, np.int64), np.zeros(centres.shape)
            near.add(rows, place, counts, total)
            sums.append((counts, total))
        assert np.array_equal(sums[0][0], sums[1][0]) and np.allclose(sums[0][1], sums[1][1])


def test_blocks_grow_with_the_table_and_are_worked_in_tiles(spark, monkeypatch):
    """How often a row is shipped for the exact silhouette does not grow with the rows; tiles give the same sums."""
    copies = [n / clusters._block_rows(n) for n in (200_000, 600_000, 2_000_000)]
    assert max(copies) <= clusters.BLOCKS and clusters._block_rows(50) == clusters.TILE
    rng = np.random.default_rng(8)
    x = rng.random((70, 3))
    points = spark.createDataFrame([(i, [float(v) for v in x[i]], i % 3) for i in range(70)], "id long, v array<double>, c int")
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    labels = np.arange(70) % 3
    got = {r["id"]: r["silhouette"] for r in clusters.silhouette_euclidean(points, "id", "v", "c").collect()}
    for i in range(70):
        mean = [gap[i][(labels == c) & (np.arange(70) != i)].mean() for c in range(3)]
        own = mean.pop(labels[i])
        assert got[i] == pytest.approx((min(mean) - own) / max(own, min(mean)), abs=1e-7)
    monkeypatch.setattr(clusters, "TILE", 7)
    tiled = {r["id"]: r["silhouette"] for r in clusters.silhouette_euclidean(points, "id", "v", "c", 40).collect()}
    assert tiled == pytest.approx(got, abs=1e-9)


def test_exact_sweep_scores_all_models_by_one_distance_each_and_leaves_no_tables(spark, monkeypatch, tmp_path):
    """All k share the distances; nothing but the rows is stored, and that only while it is needed."""
    import os

    from segmentry.operators import kmeans

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in (0, 3, 9)] + [np.full((4, 3), 2.0)])
    points = clusters.array_features(spark.createDataFrame(
        [(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, embedding array<double>")).select("id", "features")
    monkeypatch.setattr(clusters, "RECORD_ROWS", 50)
    monkeypatch.setattr(clusters, "HELD_ROWS", 7)
    monkeypatch.setattr(clusters, "SHIPPED_BYTES", 2000)
    rows, size = kmeans.kept_rows(points)
    lone = kmeans.KMeansFit(np.vstack([x[:2], [[50.0] * 3], x[:1] + 1e6]))  # a cluster without rows, too
    fits = [lone, kmeans.KMeansFit(x[[0, 70, 130]]), kmeans.KMeansFit(x[[0, 100]]), kmeans.KMeansFit(x[:1])]
    gap = np.linalg.norm(x[:, None] - x[None], axis=2)
    expected = []
    for fit in fits:
        labels = ((x[:, None] - fit.centres) ** 2).sum(axis=2).argmin(axis=1)
        score = []
        for i, own in enumerate(labels):
            mean = {c: gap[i][(labels == c) & (np.arange(len(x)) != i)].mean() for c in set(labels) if ((labels == c) & (np.arange(len(x)) != i)).any()}
            a, b = mean.pop(own, None), min(mean.values(), default=None)
            score.append(0.0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b))
        expected.append(np.mean(score))
    assert clusters.silhouettes_euclidean(rows, size, fits) == pytest.approx(expected, abs=1e-7)

    # where nothing but the sweep's own tables can be
    monkeypatch.setattr("segmentry.session.scratch_root", lambda spark: str(tmp_path))
    swept = clusters.sweep_cluster_counts(points, [2, 3], 2, "euclidean", key="id").collect()
    assert [r["number_of_clusters"] for r in swept] == [2, 3] and all(-1 <= r["silhouette_score"] <= 1 for r in swept)
    assert os.listdir(tmp_path) == []


def test_nearest_centres_in_two_precisions_are_those_in_double(spark):
    """Rows between two centres, equal centres and values far from zero are decided in double precision."""
    from segmentry.operators import kmeans

    rng = np.random.default_rng(10)
    near = rng.random((64, 5))
    for x in (near, near + 1e4, np.round(near * 3), np.zeros((64, 5))):
        centres = [np.vstack([x[:k] + 1e-9, x[:1] + 1e-9]) for k in (2, 4)] + [x[k:k + 3] * 1.0 for k in range(3)]
        groups = kmeans._groups(range(len(centres)), [kmeans.KMeansFit(c) for c in centres])
        rows = kmeans.Rows(np.arange(64, dtype=np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), x.ravel(), 5)
        both = kmeans.Nearest(groups, 5)
        mine = [(np.zeros(h.shape, np.int64), np.zeros(len(n)), np.zeros(c.shape)) for n, c, h in groups]
        both.tally(rows, mine)
        for (place, gap), least, (counts, cost, total), (_, c, h) in zip(both.places(rows), both.least(rows), mine, groups):
            member = place[None] == np.arange(len(c))[:, None, None]
            assert np.array_equal(counts, member.sum(axis=2)) and np.allclose(total, member @ x)
            assert np.allclose(least, gap, atol=1e-7) and np.allclose(cost, gap.sum(axis=1), atol=1e-3)


def test_vocabularies_count_fullest_buckets_first_and_equal_counting_all(spark, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [(i, " ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, rng.integers(0, 60)))) for i in range(300)]
    texts += [(300, None), (301, "")]
    docs = spark.createDataFrame(texts, "id int, t string").repartition(3)
    profiles = [T.Profile(r"\b\w\w+\b", 2, 0.5, 40, ("w1",)), T.Profile(r"\b\w\w+\b", 1, 0.9, 100, ("w1",)), T.Profile(r"w\d\d", 2, 1.0, 10_000, ("x",))]
    rows = T.packed_terms(docs, "t", profiles, ["id"])
    whole = [T.vocabulary(T.term_counts(docs, "id", "t", p), docs, p).orderBy("term").collect() for p in profiles]
    for buckets, per_feature in ((1 << 17, 4), (4096, 1), (8192, 30)):
        monkeypatch.setattr(T, "BUCKETS", buckets)
        monkeypatch.setattr(T, "BUCKETS_PER_FEATURE", per_feature)
        found = T.vocabularies(T.packed_terms(docs, "t", profiles, ["id"]), profiles)
        assert [[tuple(r.values()) for r in v.select(["term", "df", "total"]).to_pylist()] for v in found] == [
            [(r["term"], r["df"], r["total"]) for r in v] for v in whole]
    # tasks add up their terms before these are shuffled
    monkeypatch.setattr(T, "BUCKETS", 1 << 17)
    one = T.partial_statistics(rows.coalesce(1), np.ones((2, 1 << 17), bool))
    assert one.count() == one.select("tokenizer", "term").distinct().count()


def test_boxed_terms_are_those_of_every_row_and_hold_a_term_once(spark, monkeypatch):
    """A slice of the texts is one record, in which a term stands once; tokens, vocabularies and weights stay what Java's patterns make of every text."""
    rng = np.random.default_rng(11)
    texts = [(f"k{i}", " ".join(f"Word{'abcdefghij'[int(x) % 10]}-{'xyz'[int(x) % 3]}'s" for x in rng.zipf(1.4, rng.integers(0, 30)))) for i in range(120)]
    texts += [("null", None), ("empty", ""), ("accents", "Straße élan words İstanbul don't-stop naïve_one"), (None, "Worda-x Wordb-y a_b c-d -- E1f2"), ("null", "again wordc-z")]
    docs = spark.createDataFrame(texts, "id string, t string").repartition(2)
    profiles = [T.CATALOG, T.REVIEWS, T.COHERENCE, T.Profile(r"w\w+d", 1, 1.0, 50, ("x",))]
    monkeypatch.setattr(T, "SLICE_BYTES", 2_000)
    packed = T.packed_terms(docs, "t", profiles, ["id"]).collect()
    different = list({p.tokenizer: p for p in profiles}.values())
    words = docs.select("id", *(T.tokens(F.col("t"), p).alias(f"w_{i}") for i, p in enumerate(different))).collect()
    count = lambda ws: sorted({t: ([*ws, *map(" ".join, zip(ws, ws[1:]))]).count(t) for t in [*ws, *map(" ".join, zip(ws, ws[1:]))]}.items())
    for i in range(len(different)):
        expected = sorted((str(r["id"]), count(r[f"w_{i}"])) for r in words)
        assert sorted((str(r["id"]), sorted(zip(r[f"terms_{i}"], r[f"counts_{i}"]))) for r in packed) == expected
    boxed = T.boxed_terms(docs, "t", profiles, ["id"])
    for r in boxed.collect():
        held = T.Counted.unboxed(*(pa.scalar(bytes(r[f"{c}_0"]), pa.binary()) for c in T.BOXED))
        assert len(set(held.terms.to_pylist())) == len(held.terms) and len(held.lengths) == r["n"] and held.lengths.sum() == len(held.codes)
    assert boxed.count() < len(texts)
    one, two = (T.vocabularies(rows, profiles) for rows in (boxed, T.packed_terms(docs, "t", profiles, ["id"])))
    assert [v.to_pylist() for v in one] == [v.to_pylist() for v in two] and all(v.num_rows for v in one)
    show = lambda rows: sorted((str(r["id"]), r["indices"], [round(x, 12) for x in r["values"]]) for r in rows.collect())
    for i, v in enumerate(one):
        args = (["id"], v["term"].combine_chunks(), v["idf"].to_numpy(), i)
        assert show(T.weighed(boxed, *args, kept=docs.select("id").schema)) == show(T.weighed(T.packed_terms(docs, "t", profiles, ["id"]), *args))
