"""Stand-in views: the given tables seen as charts, games, texts, reviews and feeds.

Each view covers its whole table, row by row, and has a SQL twin with the same name
(the upper-case constants) for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---------------------------------------------------------------- charts and games

def charts(spark: SparkSession, folder: str) -> DataFrame:
    """Every order line as a chart entry of its part; some developers are unknown."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "N", "top_free").when(F.col("l_returnflag") == "A", "top_paid")
        .otherwise("top_grossing").alias("chart_type"),
        F.col("l_linenumber").alias("chart_position"), "l_quantity", "l_tax",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("snapshot_date"))
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return lines.join(parts, "p_partkey").select(
        F.col("p_partkey").cast("string").alias("app_id"), F.col("p_name").alias("title"),
        F.when(F.col("p_size") != 7, F.col("p_brand")).alias("developer"), "chart_type", "chart_position",
        F.col("p_type").alias("primary_genre"), "snapshot_date", F.col("p_size").alias("cluster_id"),
        (1 + F.rint(F.col("l_tax") * 100) / 2).alias("average_rating"),
        F.when(F.col("l_quantity") != 13, F.col("l_quantity")).alias("rating_count"),
        F.col("l_orderkey").alias("entry"), F.col("l_suppkey").alias("seller"))


CHARTS = """charts AS (
  SELECT CAST(l_partkey AS VARCHAR) AS app_id, p_name AS title,
         CASE WHEN p_size <> 7 THEN p_brand END AS developer,
         CASE l_returnflag WHEN 'N' THEN 'top_free' WHEN 'A' THEN 'top_paid' ELSE 'top_grossing' END AS chart_type,
         l_linenumber AS chart_position, p_type AS primary_genre,
         strftime(l_shipdate, '%Y-%m-%d') AS snapshot_date, p_size AS cluster_id,
         1 + round_even(l_tax * 100, 0) / 2 AS average_rating,
         CASE WHEN l_quantity <> 13 THEN l_quantity END AS rating_count,
         l_orderkey AS entry, l_suppkey AS seller
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a metadata record; some have no description."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("app_id"),
        F.when(F.col("p_size") % 5 != 0, F.concat_ws(" ", "p_name", "p_type")).alias("description"),
        F.col("p_type").alias("primary_genre"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size") / 10).alias("average_rating"),
        F.col("p_retailprice").alias("price"))


METADATA = """metadata AS (
  SELECT CAST(p_partkey AS VARCHAR) AS app_id,
         CASE WHEN p_size % 5 <> 0 THEN p_name || ' ' || p_type END AS description,
         p_type AS primary_genre,
         CASE WHEN p_size % 7 <> 0 THEN p_size / 10 END AS average_rating,
         p_retailprice AS price
  FROM part)"""


# ---------------------------------------------------------------- described games

def described(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a game with a description; the source is its segment."""
    return table(spark, folder, "documents").select(
        "doc_id", F.col("doc_id").cast("string").alias("app_id"),
        F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"),
        F.concat(F.lit("Studio "), (F.col("n_chars") % 7).cast("string")).alias("developer"),
        F.col("text").alias("description"),
        F.when(F.col("lang") == "en", "Games|Puzzle|Family").when(F.col("lang") == "fr", "Word & Trivia")
        .when(F.col("lang") == "de", "Role-Playing | Strategy").alias("genres"),
        F.when(F.col("doc_id") % 2 == 0, "top_free").otherwise("top_paid").alias("chart_type"),
        (F.col("n_chars") % 100 + 1).alias("chart_position"),
        (1 + (F.col("n_chars") % 9) / 2).alias("average_rating"),
        F.col("n_chars").cast("double").alias("rating_count"),
        F.substring("source", 4, 9).cast("int").alias("cluster_id"))


DESCRIBED = """described AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS app_id, 'Title ' || doc_id AS title,
         'Studio ' || (n_chars % 7) AS developer, text AS description,
         CASE lang WHEN 'en' THEN 'Games|Puzzle|Family' WHEN 'fr' THEN 'Word & Trivia'
                   WHEN 'de' THEN 'Role-Playing | Strategy' END AS genres,
         CASE WHEN doc_id % 2 = 0 THEN 'top_free' ELSE 'top_paid' END AS chart_type,
         n_chars % 100 + 1 AS chart_position, 1 + (n_chars % 9) / 2 AS average_rating,
         CAST(n_chars AS DOUBLE) AS rating_count, CAST(substr(source, 4) AS INTEGER) AS cluster_id
  FROM documents)"""


# ---------------------------------------------------------------- reviews

def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a review of its source; the rating follows its labels."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    rating = (F.when(F.col("quality") == 0, "1").when(F.col("toxic") == 1, "2")
              .when(F.col("quality") == 1, "5").when(F.col("n_chars") % 2 == 0, "3").otherwise("x"))
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("app_id"), F.concat(F.lit("Game "), "source").alias("game_title"),
        F.when(F.col("n_chars") % 3 != 0, F.concat(F.lit("r"), (F.col("n_chars") % 50).cast("string"))).alias("review_id"),
        F.col("text").alias("review_text"), rating.alias("review_rating"),
        F.when(F.col("n_chars") % 11 != 0, F.concat(
            F.lit("2024-01-"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0"),
            F.lit("T08:30:00+00:00"))).otherwise("soon").alias("review_date"),
        (F.col("n_chars") % 9).cast("int").alias("pain_point_id"))


REVIEWS = """reviews AS (
  SELECT d.doc_id, source AS app_id, 'Game ' || source AS game_title,
         CASE WHEN n_chars % 3 <> 0 THEN 'r' || (n_chars % 50) END AS review_id,
         text AS review_text,
         CASE WHEN quality = 0 THEN '1' WHEN toxic = 1 THEN '2' WHEN quality = 1 THEN '5'
              WHEN n_chars % 2 = 0 THEN '3' ELSE 'x' END AS review_rating,
         CASE WHEN n_chars % 11 <> 0
              THEN '2024-01-' || lpad(CAST(n_chars % 28 + 1 AS VARCHAR), 2, '0') || 'T08:30:00+00:00'
              ELSE 'soon' END AS review_date,
         CAST(n_chars % 9 AS INTEGER) AS pain_point_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def event_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a review: the user is the app, the type decides the rating."""
    rating = (F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2)
              .when(F.col("event_type") == "click", 3).when(F.col("event_type") == "signup", 4).otherwise(5))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("review_key"), F.col("user_id").cast("string").alias("app_id"),
        rating.alias("review_rating"), F.col("ts").alias("review_time"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))


EVENT_REVIEWS = """event_reviews AS (
  SELECT event_id AS review_key, CAST(user_id AS VARCHAR) AS app_id,
         CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
                         WHEN 'signup' THEN 4 ELSE 5 END AS review_rating,
         ts AS review_time, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def event_games(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer as a game that may have event reviews; its nation is the segment."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("app_id"), F.col("c_name").alias("game_title"),
        F.col("c_mktsegment").alias("developer"), F.col("c_nationkey").alias("cluster_id"))


EVENT_GAMES = """event_games AS (
  SELECT CAST(c_custkey AS VARCHAR) AS app_id, c_name AS game_title,
         c_mktsegment AS developer, c_nationkey AS cluster_id FROM customer)"""


# ---------------------------------------------------------------- landed feeds

def chart_feed_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a landed chart document with 0 to 3 entries (one: a lone object)."""
    app = F.col("o_custkey") * 10
    entry = lambda i: F.struct(
        F.struct(F.concat(F.lit("http://shop/"), (app + i).cast("string")).alias("label"),
                 F.struct((app + i).cast("string").alias("im:id")).alias("attributes")).alias("id"),
        F.struct(F.concat_ws(" ", F.lit("Game"), (app + i).cast("string")).alias("label")).alias("im:name"),
        F.when(i != 2, F.struct(F.col("o_orderpriority").alias("label"))).alias("im:artist"),
        F.struct(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("label")).alias("attributes")).alias("im:releaseDate"),
        F.struct(F.struct(F.col("o_orderstatus").alias("label")).alias("attributes")).alias("category"),
        F.when(F.col("o_orderkey") % 5 != 0, F.array(
            F.struct(F.lit("small").alias("label")),
            F.struct(F.concat(F.lit("large"), i.cast("string")).alias("label")))).alias("im:image"))
    count = (F.col("o_orderkey") % 4).cast("int")
    many = F.to_json(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), entry))
    one = F.to_json(entry(F.lit(1)))
    text = (F.when(count == 0, '{"feed":{}}').when(count == 1, F.concat(F.lit('{"feed":{"entry":'), one, F.lit("}}")))
            .otherwise(F.concat(F.lit('{"feed":{"entry":'), many, F.lit("}}"))))
    text = F.when(F.col("o_orderkey") % 97 == 0, F.lit('{"feed":{"entry":"none"}}')).otherwise(text)
    return table(spark, folder, "orders").select(
        text.alias("doc"), F.when(F.col("o_orderstatus") == "F", "top_free").otherwise("top_paid").alias("chart_type"),
        F.col("o_orderkey").cast("string").alias("source_url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("snapshot_date"))


# what the documents above say, entry by entry
CHART_FEED = """chart_feed AS (
  SELECT CAST(o_custkey * 10 + i AS VARCHAR) AS app_id, 'Game ' || (o_custkey * 10 + i) AS title,
         CASE WHEN i <> 2 THEN o_orderpriority END AS developer,
         strftime(o_orderdate, '%Y-%m-%d') AS release_date, o_orderstatus AS primary_genre,
         o_orderstatus AS genres,
         CASE WHEN o_orderkey % 5 <> 0 THEN 'large' || i END AS artwork_url,
         'http://shop/' || (o_custkey * 10 + i) AS app_store_url,
         CASE WHEN o_orderstatus = 'F' THEN 'top_free' ELSE 'top_paid' END AS chart_type,
         CAST(i AS INTEGER) AS chart_position, 'US' AS country,
         strftime(o_orderdate, '%Y-%m-%d') AS snapshot_date, CAST(o_orderkey AS VARCHAR) AS source_url
  FROM orders, (VALUES (1), (2), (3)) AS n(i)
  WHERE i <= o_orderkey % 4 AND o_orderkey % 97 <> 0)"""


def lookup_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a landed lookup record; some fields are missing or malformed."""
    size = F.col("p_size")
    record = F.struct(
        F.col("p_partkey").alias("trackId"), F.col("p_name").alias("trackName"),
        F.col("p_brand").alias("artistName"), F.col("p_type").alias("primaryGenreName"),
        F.when(size % 5 != 0, F.concat_ws(" ", "p_name", "p_type")).alias("description"),
        F.when(size % 3 == 0, F.array("p_type", "p_brand")).alias("genres"),
        F.when(size % 7 != 0, F.concat((size / 10).cast("string"))).otherwise("n/a").alias("averageUserRating"),
        size.alias("userRatingCount"), F.col("p_retailprice").alias("price"), F.lit("USD").alias("currency"),
        F.when(size % 4 != 0, F.concat(F.lit("2024-03-"), F.lpad((size % 28 + 1).cast("string"), 2, "0"),
                                       F.lit("T10:00:00Z"))).otherwise("unknown").alias("releaseDate"),
        F.array(F.col("p_brand"), F.col("p_name")).alias("supportedDevices"),
        F.when(size % 2 == 0, F.array(F.lit("EN"), F.lit("FR"))).alias("languageCodesISO2A"),
        F.when(size % 6 == 0, F.array(F.lit("shop"))).when(size % 6 == 1, F.array().cast("array<string>"))
        .alias("features"))
    return table(spark, folder, "part").select(F.to_json(record).alias("doc"))


LOOKUP = """lookup AS (
  SELECT CAST(p_partkey AS VARCHAR) AS app_id, p_name AS lookup_title, p_brand AS lookup_developer,
         CASE WHEN p_size % 5 <> 0 THEN p_name || ' ' || p_type END AS description,
         p_type AS primary_genre,
         CASE WHEN p_size % 3 = 0 THEN p_type || ' | ' || p_brand ELSE '' END AS detailed_genres,
         CASE WHEN p_size % 7 <> 0 THEN p_size / 10 END AS average_rating,
         CAST(p_size AS DOUBLE) AS rating_count, p_retailprice AS price, 'USD' AS currency,
         CASE WHEN p_size % 4 <> 0 THEN '2024-03-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0')
              || ' 10:00:00' END AS release_date,
         p_brand || ' | ' || p_name AS supported_devices,
         CASE WHEN p_size % 2 = 0 THEN 'EN | FR' ELSE '' END AS language_codes,
         p_size % 6 = 0 AS has_in_app_purchases
  FROM part)"""


def review_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a landed review page: each line of text is an entry.

    Five pages make an app. Ratings are text of several kinds, some entries lack a
    field, some pages failed; a page with one line holds a lone object.
    """
    lines = F.split("text", "\n")

    def entry(line, i):
        rating = F.element_at(F.array(*[F.lit(x) for x in RATINGS]), (F.length(line) % len(RATINGS)).cast("int") + 1)
        return F.struct(
            F.when(F.length(line) % 17 != 0, F.struct(rating.alias("label"))).alias("im:rating"),
            F.struct(line.alias("label")).alias("content"),
            F.struct(F.concat_ws("-", F.col("doc_id").cast("string"), i.cast("string")).alias("label")).alias("id"),
            F.when(F.length(line) % 3 != 0, F.struct(F.struct(F.col("lang").alias("label")).alias("name"))).alias("author"),
            F.struct(F.lit("2024-02-03T04:05:06-07:00").alias("label")).alias("updated"))

    many = F.to_json(F.transform(lines, entry))
    one = F.to_json(entry(F.element_at(lines, 1), F.lit(0)))
    doc = F.concat(F.lit('{"feed":{"entry":'), F.when(F.size(lines) == 1, one).otherwise(many), F.lit("}}"))
    return table(spark, folder, "documents").select(
        F.floor(F.col("doc_id") / 5).cast("string").alias("app_id"),
        F.concat(F.lit("Game "), F.floor(F.col("doc_id") / 5).cast("string")).alias("game_title"),
        F.col("lang").alias("developer"), (F.col("doc_id") % 5 + 1).cast("int").alias("page_number"),
        F.when(F.col("n_chars") % 13 != 0, doc).alias("doc"))


# rating texts of the entries above, by line length
RATINGS = ("4.9", "0", "6", "x", "1", "5", "3", "2.5", "-1", "5.99")

REVIEW_LINES = """page_lines AS (
  SELECT CAST(doc_id // 5 AS VARCHAR) AS app_id, CAST(doc_id % 5 + 1 AS INTEGER) AS page_number, doc_id, lang,
         n_chars % 13 = 0 AS failed, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
page_entries AS (
  SELECT *, CASE length(line) % 10 WHEN 0 THEN 4 WHEN 4 THEN 1 WHEN 5 THEN 5 WHEN 6 THEN 3 WHEN 7 THEN 2
                                   WHEN 9 THEN 5 END AS rating
  FROM page_lines WHERE NOT failed AND length(line) % 17 <> 0)"""
