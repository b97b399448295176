"""Feeds, snapshots, coercions, filters, dedupe, joins and catalog aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.contracts import key_violations, missing_columns
from segmentry.functions.columns import normalize_id, to_number, to_timestamp_utc, truth
from segmentry.operators import market, rows
from segmentry.session import scratch_path
from segmentry.sources import feeds, tables
from segmentry.workload import views as V
from segmentry.workload.views import table


# ---------------------------------------------------------------- feeds

def chart_feed_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.chart_entries(V.chart_feed_docs(spark, folder))


def chart_append(spark: SparkSession, folder: str) -> DataFrame:
    docs = V.chart_feed_docs(spark, folder)
    both = [feeds.chart_entries(docs.filter(F.col("chart_type") == c)) for c in ("top_free", "top_paid")]
    return (feeds.append_charts(both).groupBy("chart_type", "chart_position")
            .agg(F.count(F.lit(1)).alias("rows"), F.count("artwork_url").alias("with_artwork")))


def lookup_flatten(spark: SparkSession, folder: str) -> DataFrame:
    meta = feeds.lookup_records(V.lookup_docs(spark, folder))
    return meta.select("app_id", "lookup_title", "lookup_developer", "description", "primary_genre",
                       "detailed_genres", "average_rating", "rating_count", "price", "currency",
                       F.date_format("release_date", "yyyy-MM-dd HH:mm:ss").alias("release_date"),
                       "supported_devices", "language_codes", "has_in_app_purchases")


def review_entry_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = feeds.review_page_entries(V.review_pages(spark, folder))
    return pages.select("app_id", "page_number", F.size("entries").cast("long").alias("entry_count"))


def label_values(spark: SparkSession, folder: str) -> DataFrame:
    wrapped = F.to_json(F.struct(F.when(F.col("value") > 5, F.struct(F.col("event_type").alias("label"))).alias("a"),
                                 F.col("props").alias("b")))
    doc = table(spark, folder, "events").select("event_id", wrapped.alias("doc"), "props")
    return doc.select("event_id", feeds.label_of(F.get_json_object("doc", "$.a")).alias("label"),
                      feeds.label_of(F.get_json_object("doc", "$.b")).alias("no_label"))


def review_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.review_rows(V.review_pages(spark, folder)).select(
        "app_id", "page_number", "review_id",
        "reviewer", "review_text", "review_rating", "review_date", "review_version", "country")


FULL_PAGE, CAP = 6, 20


def review_page_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    facts = feeds.page_facts(V.review_pages(spark, folder))
    cut = feeds.page_cutoff(facts, full_page=FULL_PAGE, max_reviews=CAP)
    return feeds.collection_coverage(cut, CAP)


def review_cap(spark: SparkSession, folder: str) -> DataFrame:
    capped = feeds.cap_reviews(feeds.review_rows(V.review_pages(spark, folder)), CAP)
    return capped.select("app_id", "page_number", "review_id", "review_rating")


# ---------------------------------------------------------------- snapshots and contracts

def csv_contract_read(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "parts-csv")
    tables.write_table(table(spark, folder, "part"), path, csv=True)
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    return tables.read_csv(spark, path, schema, ("p_partkey", "p_name"), "part")


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return tables.latest_snapshot(V.charts(spark, folder), "snapshot_date").select(
        "app_id", "chart_type", "chart_position", "snapshot_date")


def snapshot_load(spark: SparkSession, folder: str) -> DataFrame:
    raw = V.charts(spark, folder).withColumn("chart_position", F.when(
        F.col("rating_count").isNotNull(), F.col("chart_position").cast("string")).otherwise("?"))
    return tables.load_snapshot(raw).groupBy("chart_type", "chart_position").agg(
        F.count(F.lit(1)).alias("rows"), F.count("developer").alias("developers"))


# ---------------------------------------------------------------- coercion and filters

def id_normalize(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.lit(" "), (F.col("p_partkey") + F.col("p_size") / 100).cast("decimal(18,2)").cast("string"))
    return table(spark, folder, "part").select("p_partkey", normalize_id(raw).alias("app_id"))


def number_coerce(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("value") < 3, "n/a").when(F.col("value") < 5, "").otherwise(F.col("value").cast("string"))
    return table(spark, folder, "events").select("event_id", to_number(text).alias("number"))


def timestamp_coerce(spark: SparkSession, folder: str) -> DataFrame:
    reviews = V.reviews(spark, folder)
    at = to_timestamp_utc(F.col("review_date"))
    return reviews.select("doc_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("review_time"))


def default_fill(spark: SparkSession, folder: str) -> DataFrame:
    games = tables.catalog_games(V.charts(spark, folder))
    return games.select("app_id", "title", "developer")


def description_filter(spark: SparkSession, folder: str) -> DataFrame:
    return tables.described_games(V.described(spark, folder)).select(
        "app_id", F.length("description").alias("length"), "average_rating", "chart_position")


def segment_members(spark: SparkSession, folder: str) -> DataFrame:
    return market.segment_members(V.charts(spark, folder), 3).select(
        "app_id", "title", "chart_type", "chart_position", "entry", "seller", "rating_count")


def category_filter(spark: SparkSession, folder: str) -> DataFrame:
    chosen = market.category_filter(V.charts(spark, folder), "primary_genre", ["ECONOMY", "SMALL"])
    return chosen.groupBy("primary_genre", "chart_type").agg(F.count(F.lit(1)).alias("rows"))


def category_options(spark: SparkSession, folder: str) -> DataFrame:
    return market.category_options(V.charts(spark, folder), "developer")


def truth_filter(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    text = F.element_at(F.array(*[F.lit(x) for x in ("True", "1", "yes", "no", "0", "FALSE")]),
                        (F.col("user_id") % 6 + 1).cast("int"))
    return events.filter(truth(text)).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


# ---------------------------------------------------------------- dedupe and joins

def first_per_chart(spark: SparkSession, folder: str) -> DataFrame:
    order = ["chart_position", "entry", "seller", "rating_count", "average_rating", "snapshot_date"]
    return tables.chart_keys(V.charts(spark, folder), order).select(
        "app_id", "chart_type", "chart_position", "entry", "seller")


def first_per_app(spark: SparkSession, folder: str) -> DataFrame:
    return rows.first_per_key(V.charts(spark, folder), ["app_id"], ["entry", "chart_position", "seller"]).select(
        "app_id", "entry", "chart_position", "seller", "developer")


def distinct_ids(spark: SparkSession, folder: str) -> DataFrame:
    return rows.distinct_values(V.charts(spark, folder), "app_id")


def metadata_join(spark: SparkSession, folder: str) -> DataFrame:
    # lookups of dear games came under another id
    other = F.when(F.col("price") < 1000, F.col("app_id")).otherwise(F.concat(F.lit("x"), "app_id"))
    enriched = tables.enrich(V.charts(spark, folder), V.metadata(spark, folder).withColumn("app_id", other), check=True)
    return enriched.groupBy("primary_genre_x", "primary_genre_y", "metadata_found").agg(
        F.count(F.lit(1)).alias("rows"), F.count("average_rating_y").alias("ratings"))


def enrichment_quality(spark: SparkSession, folder: str) -> DataFrame:
    enriched = tables.enrich(V.charts(spark, folder).drop("average_rating"), V.metadata(spark, folder))
    return market.enrichment_quality(enriched)


def key_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    return key_violations(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def column_contract(spark: SparkSession, folder: str) -> DataFrame:
    absent = missing_columns(V.charts(spark, folder), ["app_id", "price", "description", "title"])
    counts = V.charts(spark, folder).agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("rows", F.lit(", ".join(absent)).alias("missing"))


# ---------------------------------------------------------------- aggregates and top lists

def market_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return market.market_metrics(V.charts(spark, folder))


def developer_presence(spark: SparkSession, folder: str) -> DataFrame:
    return market.developer_presence(V.charts(spark, folder))


def top_games(spark: SparkSession, folder: str) -> DataFrame:
    tie = [F.desc("rating_count"), "app_id", "entry", "seller"]
    return market.top_games(V.charts(spark, folder), "top_free", 10, tie).select(
        "chart_position", "rating_count", "app_id", "entry", "title")


def snapshot_facts(spark: SparkSession, folder: str) -> DataFrame:
    return market.snapshot_summary(
        V.charts(spark, folder), V.charts(spark, folder).select("cluster_id").distinct(),
        V.reviews(spark, folder), V.reviews(spark, folder).select("pain_point_id").distinct())


def lookup_batches(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("app_id"))
    batches = rows.id_batches(ids, "app_id", ["p_partkey"])
    return batches.select("batch_id", F.array_join("ids", ",").alias("ids"), "batch_rows")


QUERIES = {f.__name__: f for f in (
    chart_feed_flatten, chart_append, lookup_flatten, review_entry_extract, label_values, review_flatten,
    review_page_cutoff, review_cap, csv_contract_read, latest_snapshot, snapshot_load, id_normalize,
    number_coerce, timestamp_coerce, default_fill, description_filter, segment_members, category_filter,
    category_options, truth_filter, first_per_chart, first_per_app, distinct_ids, metadata_join,
    enrichment_quality, key_cardinality, column_contract, market_metrics, developer_presence, top_games,
    snapshot_facts, lookup_batches)}

SQL = {
    "chart_feed_flatten": f"WITH {V.CHART_FEED} SELECT * FROM chart_feed",
    "chart_append": f"""WITH {V.CHART_FEED}
        SELECT chart_type, chart_position, count(*) AS rows, count(artwork_url) AS with_artwork
        FROM chart_feed GROUP BY 1, 2""",
    "lookup_flatten": f"WITH {V.LOOKUP} SELECT * FROM lookup",
    "review_entry_extract": f"""WITH {V.REVIEW_LINES}
        SELECT app_id, page_number, count(*) FILTER (WHERE NOT failed AND length(line) % 17 <> 0) AS entry_count
        FROM page_lines GROUP BY 1, 2""",
    "label_values": """SELECT event_id, CASE WHEN value > 5 THEN event_type END AS label,
        CAST(NULL AS VARCHAR) AS no_label FROM events""",
    "review_flatten": f"""WITH {V.REVIEW_LINES}
        SELECT app_id, page_number, doc_id || '-' || pos AS review_id,
               CASE WHEN length(line) % 3 <> 0 THEN lang END AS reviewer, line AS review_text,
               rating AS review_rating, '2024-02-03T04:05:06-07:00' AS review_date,
               CAST(NULL AS VARCHAR) AS review_version, 'US' AS country
        FROM page_entries WHERE rating IS NOT NULL""",
    "review_page_cutoff": f"""WITH {V.REVIEW_LINES},
        facts AS (SELECT app_id, page_number, bool_or(failed) AS failed,
                    count(*) FILTER (WHERE NOT failed AND length(line) % 17 <> 0) AS entries
                  FROM page_lines GROUP BY 1, 2),
        parsed AS (SELECT app_id, page_number, count(rating) AS n FROM page_entries GROUP BY 1, 2),
        pages AS (SELECT f.app_id, f.page_number, f.failed, f.entries, coalesce(n, 0) AS n,
                    sum(coalesce(n, 0)) OVER w AS so_far,
                    row_number() OVER w <> f.page_number AS gap
                  FROM facts f LEFT JOIN parsed p ON f.app_id = p.app_id AND f.page_number = p.page_number
                  WINDOW w AS (PARTITION BY f.app_id ORDER BY f.page_number)),
        reasons AS (SELECT *, CASE WHEN failed OR gap THEN 'failed' WHEN entries = 0 THEN 'empty'
                      WHEN so_far >= {CAP} THEN 'capped' WHEN n < {FULL_PAGE} THEN 'short' END AS reason FROM pages),
        first_stop AS (SELECT app_id, min(page_number) AS stop FROM reasons WHERE reason IS NOT NULL GROUP BY 1),
        seen AS (SELECT r.* FROM reasons r LEFT JOIN first_stop s ON r.app_id = s.app_id
                 WHERE s.stop IS NULL OR r.page_number <= s.stop)
        SELECT app_id,
          least(sum(CASE WHEN reason IS NULL OR reason IN ('capped', 'short') THEN n ELSE 0 END), {CAP})::BIGINT
            AS reviews_collected,
          count(*) FILTER (WHERE reason IS NULL OR reason = 'short') AS pages_collected,
          coalesce(bool_or(reason = 'failed'), false) AS request_failed
        FROM seen GROUP BY 1""",
    "review_cap": f"""WITH {V.REVIEW_LINES}
        SELECT app_id, page_number, review_id, rating AS review_rating FROM (
          SELECT *, doc_id || '-' || pos AS review_id,
                 row_number() OVER (PARTITION BY app_id ORDER BY page_number, pos) AS n
          FROM page_entries WHERE rating IS NOT NULL) WHERE n <= {CAP}""",
    "csv_contract_read": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    "latest_snapshot": f"""WITH {V.CHARTS}
        SELECT app_id, chart_type, chart_position, snapshot_date FROM charts
        WHERE snapshot_date = (SELECT max(snapshot_date) FROM charts)""",
    "snapshot_load": f"""WITH {V.CHARTS}
        SELECT chart_type, chart_position, count(*) AS rows, count(developer) AS developers FROM charts
        WHERE rating_count IS NOT NULL GROUP BY 1, 2""",
    "id_normalize": """SELECT p_partkey,
        trim(replace(' ' || CAST(CAST(p_partkey + p_size / 100 AS DECIMAL(18, 2)) AS VARCHAR), '.0', '')) AS app_id
        FROM part""",
    "number_coerce": """SELECT event_id, CASE WHEN value >= 5 THEN value END AS number FROM events""",
    "timestamp_coerce": f"""WITH {V.REVIEWS}
        SELECT doc_id, CASE WHEN review_date <> 'soon'
          THEN substr(review_date, 1, 10) || ' ' || substr(review_date, 12, 8) END AS review_time FROM reviews""",
    "default_fill": f"""WITH {V.CHARTS}
        SELECT DISTINCT app_id, title, coalesce(developer, 'Unknown') AS developer FROM charts""",
    "description_filter": f"""WITH {V.DESCRIBED}
        SELECT app_id, CAST(length(t) AS INTEGER) AS length, average_rating,
               CAST(chart_position AS DOUBLE) AS chart_position
        FROM (SELECT *, trim(description, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
              FROM described) WHERE length(t) >= 50""",
    "segment_members": f"""WITH {V.CHARTS}
        SELECT app_id, title, chart_type, chart_position, entry, seller, rating_count
        FROM charts WHERE cluster_id = 3""",
    "category_filter": f"""WITH {V.CHARTS}
        SELECT primary_genre, chart_type, count(*) AS rows FROM charts
        WHERE primary_genre IN ('ECONOMY', 'SMALL') GROUP BY 1, 2""",
    "category_options": f"WITH {V.CHARTS} SELECT DISTINCT developer FROM charts WHERE developer IS NOT NULL",
    "truth_filter": """SELECT event_type, count(*) AS rows FROM events WHERE user_id % 6 < 3 GROUP BY 1""",
    "first_per_chart": f"""WITH {V.CHARTS}
        SELECT app_id, chart_type, chart_position, entry, seller FROM (
          SELECT *, row_number() OVER (PARTITION BY app_id, chart_type ORDER BY chart_position, entry, seller) AS n
          FROM charts) WHERE n = 1""",
    "first_per_app": f"""WITH {V.CHARTS}
        SELECT app_id, entry, chart_position, seller, developer FROM (
          SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY entry, chart_position, seller) AS n
          FROM charts) WHERE n = 1""",
    "distinct_ids": f"WITH {V.CHARTS} SELECT DISTINCT app_id FROM charts",
    "metadata_join": f"""WITH {V.CHARTS}, {V.METADATA}
        SELECT c.primary_genre AS primary_genre_x, m.primary_genre AS primary_genre_y,
               m.description IS NOT NULL AS metadata_found, count(*) AS rows, count(m.average_rating) AS ratings
        FROM charts c LEFT JOIN metadata m ON c.app_id = CASE WHEN m.price < 1000 THEN m.app_id ELSE 'x' || m.app_id END
        GROUP BY 1, 2, 3""",
    "enrichment_quality": f"""WITH {V.CHARTS}, {V.METADATA}
        SELECT count(*) AS total_rows, count(m.description) AS metadata_found,
               count(*) - count(m.description) AS metadata_missing,
               count(m.average_rating) AS ratings_available, count(m.description) AS descriptions_available
        FROM charts c LEFT JOIN metadata m ON c.app_id = m.app_id""",
    "key_cardinality": """SELECT l_orderkey, l_linenumber, count(*) AS key_rows FROM lineitem
        GROUP BY 1, 2 HAVING count(*) > 1""",
    "column_contract": f"WITH {V.CHARTS} SELECT count(*) AS rows, 'description, price' AS missing FROM charts",
    "market_metrics": f"""WITH {V.CHARTS}
        SELECT count(*) AS total_rows, count(DISTINCT app_id) AS unique_games,
               count(DISTINCT CASE WHEN chart_type = 'top_free' THEN app_id END) AS free_games,
               count(DISTINCT CASE WHEN chart_type = 'top_paid' THEN app_id END) AS paid_games,
               count(DISTINCT developer) AS developers FROM charts""",
    "developer_presence": f"""WITH {V.CHARTS}
        SELECT developer, count(DISTINCT app_id) AS ranked_games, count(*) AS chart_entries FROM charts
        WHERE developer IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""",
    "top_games": f"""WITH {V.CHARTS}
        SELECT chart_position, rating_count, app_id, entry, title FROM charts WHERE chart_type = 'top_free'
        ORDER BY chart_position, rating_count DESC NULLS LAST, app_id, entry, seller LIMIT 10""",
    "snapshot_facts": f"""WITH {V.CHARTS}, {V.REVIEWS}
        SELECT (SELECT count(DISTINCT app_id) FROM charts) AS games,
               (SELECT count(DISTINCT cluster_id) FROM charts) AS segments,
               (SELECT count(*) FROM reviews) AS reviews,
               (SELECT count(DISTINCT pain_point_id) FROM reviews) AS pain_points""",
    "lookup_batches": """SELECT n // 25 AS batch_id, string_agg(app_id, ',' ORDER BY n) AS ids, count(*) AS batch_rows
        FROM (SELECT CAST(p_partkey AS VARCHAR) AS app_id, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)
        GROUP BY 1""",
}
