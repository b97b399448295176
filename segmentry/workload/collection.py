"""Landed feeds to enriched charts and reviews, snapshots, bundles, tolerant reads and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.contracts import stored_checked
from segmentry.plans import collection
from segmentry.schemas import TABLES
from segmentry.session import materialize, scratch_path, together
from segmentry.sources import snapshots, tables
from segmentry.workload import views as V
from segmentry.workload.views import table

#: Documents of a landed file at most.
LANDED_ROWS = 100_000


def _landed(spark: SparkSession, folder: str) -> dict[str, str]:
    """Feeds written as they land; the lookups of large parts are missing."""
    feeds = {"chart_docs": V.chart_feed_docs(spark, folder), "lookup_docs": V.lookup_docs(spark, folder), "review_pages": V.review_pages(spark, folder)}
    paths = {name: scratch_path(spark, name) for name in feeds}
    # files of even size, so that the tasks that parse them take about as long as each other
    together(spark, *(lambda n=name, d=docs: d.write.option("maxRecordsPerFile", LANDED_ROWS).parquet(paths[n]) for name, docs in feeds.items()))
    return paths


def collect_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """Enriched chart rows of the whole run over landed feeds."""
    found = collection.run_collection(spark, scratch_path(spark, "collection"), **_landed(spark, folder))
    return found.enriched.select(
        "app_id", "title", "developer", "chart_type", "chart_position", "snapshot_date", "source_url", "artwork_url",
        "lookup_title", "lookup_developer", "description", "detailed_genres", "average_rating", "rating_count", "price", "currency",
        "supported_devices", "language_codes", "metadata_found")


def collect_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of all games after the whole run; games without pages have no reviews."""
    found = collection.run_collection(spark, scratch_path(spark, "collection"), **_landed(spark, folder))
    total = found.reviews.agg(F.count(F.lit(1))).scalar()
    kept = found.coverage.agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("reviews_collected") > 0).alias("with_reviews"),
                              F.sum("reviews_collected").alias("covered"))
    wanted = found.enriched.select("app_id").distinct()
    of_games = found.reviews.join(wanted, "app_id", "left_semi").agg(F.count(F.lit(1))).scalar()
    return kept.select("games", (F.col("covered") == of_games).alias("covers_reviews"), (total >= of_games).alias("of_all_reviews"),
                       (F.col("with_reviews") <= F.col("games")).alias("of_all_games"))


def collection_rerun(spark: SparkSession, folder: str) -> DataFrame:
    """Stages run by a first run, by one on the same feeds, and by one with other limits; rows of the last."""
    paths, root = _landed(spark, folder), scratch_path(spark, "collection")
    runs = [collection.run_collection(spark, root, **paths, **limits) for limits in ({}, {}, {"max_reviews": 3})]
    ran = [",".join(r.ran) for r in runs]
    bad = F.coalesce(runs[-1].rejected.agg(F.sum("documents")).scalar(), F.lit(0))
    return runs[-1].enriched.agg(F.count(F.lit(1)).alias("enriched"), F.count_if("metadata_found").alias("found")).select(
        *(F.lit(r).alias(name) for r, name in zip(ran, ("first", "again", "other_limits"))), "enriched", "found", bad.alias("bad_documents"))


def snapshot_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two whole chart snapshots, the second one replaced, and a half-written third; all rows of the whole ones."""
    path = scratch_path(spark, "snapshots")
    # stored, since four writes read them
    charts = materialize(V.charts(spark, folder).select("app_id", "title", "developer", "chart_type", "chart_position"), "charts")
    later = charts.withColumn("chart_position", F.col("chart_position") + 1)
    snapshots.commit_snapshot(charts, path, "20240101_000000")
    snapshots.commit_snapshot(charts, path, "20240102_000000")
    snapshots.commit_snapshot(later, path, "20240102_000000")
    snapshots.write_attempt(later, path, "20240103_000000")
    newest = snapshots.read_snapshot(spark, path).agg(F.max("snapshot_ts")).scalar()
    # rows meet by chart place and app before they are counted, so that a task holds the groups of one partition only
    place = ["snapshot_ts", "chart_type", "chart_position"]
    per_app = snapshots.all_snapshots(spark, path).select(*place, "app_id", "developer").repartition(*place, "app_id").groupBy(
        *place, "app_id").agg(F.count(F.lit(1)).alias("rows"), F.count("developer").alias("developers"))
    return per_app.groupBy(*place).agg(
        F.sum("rows").alias("rows"), F.count("app_id").alias("apps"), F.sum("developers").alias("developers")).withColumn(
        "is_newest", F.col("snapshot_ts") == newest)


def bundle_load(spark: SparkSession, folder: str) -> DataFrame:
    """All tables of a bundle written, read back with their checks and counted."""
    root = scratch_path(spark, "bundle")
    # stored, since every table is written from them: parts are sent round once, not once a table
    needed = ["app_id", "title", "developer", "chart_type", "chart_position", "cluster_id", "average_rating", "rating_count"]
    stored = materialize(V.charts(spark, folder).select(*needed), "charts")
    charts = stored.withColumnRenamed("rating_count", "reviews_collected").withColumns({
        "game_title": F.col("title"), "game_count": F.lit(1), "keywords": F.col("title"), "representative_games": F.col("title"),
        "cluster_name": F.col("title"), "adjusted_opportunity_score": F.col("average_rating"), "segment_type": F.col("chart_type"),
        "review_text": F.col("title"), "review_rating": F.col("average_rating"), "pain_point_id": F.col("cluster_id"),
        "representative_reviews": F.col("title"), "pain_point_share": F.col("average_rating")})
    for place, (name, (_, required)) in enumerate(TABLES.items()):
        charts.filter(F.col("chart_position") > place % 3).select(*required).write.parquet(f"{root}/{name}")
    bundle = tables.load_bundle(spark, root)
    counted = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in bundle.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


def tolerant_read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a table that is there, of one that is missing, and of a file of another kind."""
    schema = "p_partkey long, p_name string"
    text = scratch_path(spark, "text")
    table(spark, folder, "part").select(F.col("p_name")).write.text(text)
    paths = {"there": f"{folder}/part.parquet", "missing": f"{text}-none", "other_kind": text}
    parts = [tables.read_or_empty(spark, path, schema).agg(F.lit(name).alias("kind"), F.count("p_partkey").alias("rows"))
             for name, path in paths.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def newest_file(spark: SparkSession, folder: str) -> DataFrame:
    """Two landed CSV files, the second one written later: the rows of the newest."""
    path = scratch_path(spark, "files")
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    for name, rows in (("b", parts), ("a", parts.withColumn("p_size", F.col("p_size") + 1))):
        rows.coalesce(1).write.option("header", True).csv(f"{path}/{name}")
    newest = tables.latest_file(spark, path, "csv", header=True)
    return newest.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"))


def sample_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Guards counted by the write itself: how many rows each wants, and whether it held."""
    out = []
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    for what, condition in (("texts", F.length("text") >= 50), ("english", F.col("lang") == "en"), ("klingon", F.col("lang") == "tlh")):
        for minimum in (1, 1_000_000_000):
            try:
                stored_checked(docs, scratch_path(spark, "guarded"), {what: (condition, minimum)})
                out.append((what, minimum, True))
            except ValueError:
                out.append((what, minimum, False))
    held = spark.createDataFrame(out, "guard string, minimum long, held boolean")
    return held.withColumn("documents", docs.agg(F.count(F.lit(1))).scalar())


def review_ingest_unique(spark: SparkSession, folder: str) -> DataFrame:
    """All pages landed twice in different steps: every review once, in few files."""
    from segmentry.streaming import ingest

    landed, out, state, into = (scratch_path(spark, n) for n in ("landed", "batches", "state", "compact"))
    for _ in range(2):
        V.review_pages(spark, folder).write.mode("append").parquet(landed)
        ingest.load_reviews(spark, landed, out, state, files_per_step=4, unique=True)
    return ingest.compact(spark, out, into).groupBy("review_rating", "page_number").agg(F.count(F.lit(1)).alias("reviews"))


QUERIES = {f.__name__: f for f in (
    collect_enrich, collect_reviews, collection_rerun, snapshot_append, bundle_load, tolerant_read, newest_file, sample_guards,
    review_ingest_unique)}

_TABLE_ROWS = " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", count(*) AS rows FROM charts WHERE chart_position > {place % 3}" for place, name in enumerate(TABLES))
_ENRICHED = f"""{V.CHART_FEED}, {V.LOOKUP}, enriched AS (
    SELECT c.app_id, c.title, c.developer, chart_type, chart_position, snapshot_date, source_url, artwork_url, lookup_title, lookup_developer,
           description, detailed_genres, average_rating, rating_count, price, currency, supported_devices, language_codes,
           description IS NOT NULL AS metadata_found
    FROM chart_feed c LEFT JOIN lookup l ON c.app_id = l.app_id)"""
SQL = {
    "collect_enrich": f"WITH {_ENRICHED} SELECT * FROM enriched",
    "collect_reviews": f"""WITH {V.CHART_FEED} SELECT count(DISTINCT app_id) AS games, TRUE AS covers_reviews, TRUE AS of_all_reviews,
        TRUE AS of_all_games FROM chart_feed""",
    "collection_rerun": f"""WITH {_ENRICHED} SELECT 'collect,enrich,reviews' AS first, '' AS again, 'reviews' AS other_limits,
        count(*) AS enriched, count(*) FILTER (metadata_found) AS found,
        (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0) AS bad_documents FROM enriched""",
    "snapshot_append": f"""WITH {V.CHARTS}, days AS (
          SELECT '20240101_000000' AS snapshot_ts, FALSE AS is_newest, * FROM charts
          UNION ALL SELECT '20240102_000000', TRUE, * REPLACE (chart_position + 1 AS chart_position) FROM charts)
        SELECT snapshot_ts, chart_type, chart_position, count(*) AS rows, count(DISTINCT app_id) AS apps, count(developer) AS developers,
               is_newest FROM days GROUP BY ALL""",
    "bundle_load": f"WITH {V.CHARTS} {_TABLE_ROWS}",
    "tolerant_read": """SELECT 'there' AS kind, count(*) AS rows FROM part
        UNION ALL VALUES ('missing', 0::BIGINT), ('other_kind', 0::BIGINT)""",
    "newest_file": "SELECT p_partkey, p_size + 1 AS p_size FROM part",
    "sample_guards": """WITH found AS (
          SELECT 'texts' AS guard, count(*) FILTER (length("text") >= 50) AS n FROM documents
          UNION ALL SELECT 'english', count(*) FILTER (lang = 'en') FROM documents
          UNION ALL SELECT 'klingon', count(*) FILTER (lang = 'tlh') FROM documents)
        SELECT guard, minimum, n >= minimum AS held, (SELECT count(*) FROM documents) AS documents
        FROM found, (VALUES (1::BIGINT), (1000000000::BIGINT)) AS m(minimum)""",
    "review_ingest_unique": f"""WITH {V.REVIEW_LINES}
        SELECT rating AS review_rating, page_number, count(*) AS reviews FROM page_entries WHERE rating IS NOT NULL GROUP BY 1, 2""",
}
