"""Text cleaning, corpora, TF-IDF tables, keywords and coherence over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions import constants as K
from segmentry.functions import text as X
from segmentry.functions.columns import join_list, split_list
from segmentry.operators import reviews as R
from segmentry.operators import tfidf as T
from segmentry.sources import tables
from segmentry.workload import views as V
from segmentry.workload.views import table


# ---------------------------------------------------------------- SQL pieces

# the database knows ASCII whitespace only, and the given texts hold no other
URL = r"(?:https?://|www\.)\S+"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _blank(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', ' ', 'g')"


def sql_description(column: str) -> str:
    """Cleaned description; the words are bound by a sub-select."""
    text = f"lower(coalesce({column}, ''))"
    for pattern in (URL, K.EMAIL, K.HTML_TAG, K.NON_LETTER):
        text = _blank(text, pattern)
    words = (f"list_filter(list_transform(string_split_regex({text}, '\\s+'), lambda w: trim(w, '-')), "
             f"lambda w: length(w) >= 3 AND w NOT IN ({quoted(K.CATALOG_STOPWORDS)}))")
    return (f"(SELECT array_to_string(list_filter(ws, lambda w, i: i = 1 OR w <> ws[i - 1]), ' ') "
            f"FROM (SELECT {words} AS ws))")


def sql_review(column: str) -> str:
    text = _blank(_blank(f"lower(coalesce({column}, ''))", URL), K.NON_LETTER_KEEP_APOSTROPHE)
    return (f"array_to_string(list_filter(list_transform(string_split_regex({text}, '\\s+'), "
            f"lambda w: trim(w, '''-')), lambda w: length(w) >= 3 "
            f"AND w NOT IN ({quoted(K.REVIEW_STOPWORDS)})), ' ')")


def sql_genres(column: str) -> str:
    text = _blank(f"replace(lower(coalesce({column}, '')), '|', ' ')", K.NON_LETTER)
    words = (f"array_to_string(list_filter(string_split_regex({text}, '\\s+'), lambda w: length(w) >= 3 "
             f"AND w NOT IN ({quoted(K.CATALOG_STOPWORDS)})), ' ')")
    return f"trim({words} || ' ' || {words})"


def sql_tfidf(docs: str, key: str, text: str, profile: T.Profile, extra: str = "", name: str = "tfidf") -> str:
    """CTEs ending in `name`(key, extra, term, weight) plus `name`_vocab."""
    more = f", {extra}" if extra else ""
    pattern = profile.token_pattern.replace("'", "''")
    return f"""{name}_words AS (
      SELECT {key}{more}, list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{pattern}'),
        lambda t: t NOT IN ({quoted(profile.stopwords)})) AS ws FROM {docs}),
    {name}_terms AS (
      SELECT {key}{more}, unnest(ws) AS term FROM {name}_words
      UNION ALL
      SELECT {key}{more}, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term
      FROM {name}_words),
    {name}_tf AS (SELECT {key}{more}, term, count(*) AS tf FROM {name}_terms GROUP BY ALL),
    {name}_vocab AS (
      SELECT term, count(*) AS df, sum(tf)::BIGINT AS total,
             ln((1.0 + (SELECT count(*) FROM {docs})) / (1.0 + count(*))) + 1.0 AS idf
      FROM {name}_tf GROUP BY 1
      HAVING count(*) >= {profile.min_df} AND count(*) <= {profile.max_df}::DOUBLE * (SELECT count(*) FROM {docs})
      ORDER BY total DESC, term LIMIT {profile.max_features}),
    {name}_raw AS (
      SELECT t.*, (1.0 + ln(tf)) * idf AS raw FROM {name}_tf t JOIN {name}_vocab v ON t.term = v.term),
    {name} AS (
      SELECT {key}{more}, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY {key})) AS weight FROM {name}_raw)"""


CORPUS = f"""games AS (SELECT * FROM described
    WHERE length(trim(description, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 50),
  corpus AS (SELECT games.*, trim({sql_description('description')} || ' ' || {sql_genres('genres')}) AS cleaned_text
             FROM games)"""
NEGATIVES = f"""negatives AS (
    SELECT * EXCLUDE (n) FROM (
      SELECT *, {sql_review('review_text')} AS cleaned_review,
             row_number() OVER (PARTITION BY app_id, review_text ORDER BY doc_id) AS n
      FROM reviews WHERE review_rating IN ('1', '2'))
    WHERE n = 1 AND length(cleaned_review) >= 15)"""


# ---------------------------------------------------------------- views of cleaned text

def corpus(spark: SparkSession, folder: str) -> DataFrame:
    games = tables.described_games(V.described(spark, folder))
    return games.withColumn("cleaned_text", X.corpus_text(F.col("description"), F.col("genres")))


def negatives(spark: SparkSession, folder: str) -> DataFrame:
    return R.negative_reviews(V.reviews(spark, folder), ["doc_id"])


def _term_report(docs: DataFrame, key: str, text: str, profile: T.Profile) -> DataFrame:
    fitted = T.fit(docs, key, text, profile, 0)
    sums = fitted.weights.groupBy("term").agg(
        F.round(F.sum("weight"), 6).alias("weight_sum"), F.round(F.max("weight"), 6).alias("weight_max"))
    return sums.join(fitted.vocabulary.select("term", "df", "total"), "term")


def _sql_report(prefix: str, docs: str, key: str, text: str, profile: T.Profile) -> str:
    return f"""WITH {prefix}, {sql_tfidf(docs, key, text, profile)}
      SELECT v.term, df, total, round(sum(weight), 6) AS weight_sum, round(max(weight), 6) AS weight_max
      FROM tfidf t JOIN tfidf_vocab v ON t.term = v.term GROUP BY 1, 2, 3"""


# ---------------------------------------------------------------- queries

def description_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", X.clean_description(F.col("text")).alias("cleaned"))


def page_text_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        "page_id", X.clean_description(F.col("html")).alias("cleaned"))


def genre_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return V.described(spark, folder).select("doc_id", X.genre_terms(F.col("genres")).alias("genre_text"))


def corpus_build(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", "cleaned_text")


def review_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.clean_review(F.col("text")).alias("cleaned"))


def conversation_clean(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", X.clean_review(F.col("text")).alias("cleaned"))


def list_split(spark: SparkSession, folder: str) -> DataFrame:
    items = split_list(F.col("genres"))
    return V.described(spark, folder).select(
        "doc_id", join_list(items, ";").alias("items"), F.size(items).cast("long").alias("item_count"))


def keyword_filter(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(F.split("text", r"\s+")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return counted.filter(X.is_useful_keyword(F.col("word")))


def example_clip(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.clip_example(F.col("text")).alias("example"))


def complaint_labels(spark: SparkSession, folder: str) -> DataFrame:
    keywords = F.when(F.col("p_size") != 7, F.concat_ws(" | ", "p_name", "p_brand", "p_type", "p_size"))
    return table(spark, folder, "part").select("p_partkey", X.complaint_label(keywords).alias("label"))


def tfidf_catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _term_report(corpus(spark, folder).select("doc_id", "cleaned_text"), "doc_id", "cleaned_text", T.CATALOG)


def tfidf_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return _term_report(negatives(spark, folder), "doc_id", "cleaned_review", T.REVIEWS)


def tfidf_coherence(spark: SparkSession, folder: str) -> DataFrame:
    return _term_report(corpus(spark, folder), "doc_id", "cleaned_text", T.COHERENCE)


def tfidf_embedding_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return _term_report(corpus(spark, folder), "doc_id", "cleaned_text", T.EMBEDDING_KEYWORDS)


def segment_keywords(spark: SparkSession, folder: str) -> DataFrame:
    fitted = T.fit(corpus(spark, folder), "doc_id", "cleaned_text", T.CATALOG, 0, ["cluster_id"])
    return T.cluster_keywords(fitted.weights, fitted.entries)


def segment_coherence(spark: SparkSession, folder: str) -> DataFrame:
    fitted = T.fit(corpus(spark, folder), "doc_id", "cleaned_text", T.COHERENCE, 0, ["cluster_id"])
    out = T.coherence(fitted.weights, fitted.entries)
    return out.select("cluster_id", F.round("semantic_coherence", 9).alias("semantic_coherence"))


def pain_point_keywords(spark: SparkSession, folder: str) -> DataFrame:
    fitted = T.fit(negatives(spark, folder), "doc_id", "cleaned_review", T.REVIEWS, 0, ["pain_point_id"])
    return T.cluster_keywords(fitted.weights, fitted.entries, 10, "pain_point_id")


QUERIES = {f.__name__: f for f in (
    description_clean, page_text_clean, genre_normalize, corpus_build, review_clean, conversation_clean,
    list_split, keyword_filter, example_clip, complaint_labels, tfidf_catalog, tfidf_reviews, tfidf_coherence,
    tfidf_embedding_keywords, segment_keywords, segment_coherence, pain_point_keywords)}


def sql_keywords(docs: str, key: str, cluster: str, limit: int, name: str = "tfidf") -> str:
    """CTE `keywords`({cluster}, keywords) over the TF-IDF table `name`."""
    return f"""keyword_ranks AS (
      SELECT t.{cluster}, term, row_number() OVER (
               PARTITION BY t.{cluster} ORDER BY round(sum(weight) / any_value(s.n), 12) DESC, term) AS r
      FROM {name} t JOIN (SELECT {cluster}, count(*) AS n FROM {docs} GROUP BY 1) s ON t.{cluster} = s.{cluster}
      GROUP BY t.{cluster}, term),
    keywords AS (
      SELECT d.{cluster}, coalesce(string_agg(term, ' | ' ORDER BY r), '') AS keywords
      FROM (SELECT DISTINCT {cluster} FROM {docs}) d
      LEFT JOIN (SELECT * FROM keyword_ranks WHERE r <= {limit}) k ON d.{cluster} = k.{cluster} GROUP BY 1)"""


# mean cosine of each document to its segment's mean vector, term by term
SQL_COHERENCE = f"""{sql_tfidf('corpus', 'doc_id', 'cleaned_text', T.COHERENCE, 'cluster_id', 'coh')},
  coh_sizes AS (SELECT cluster_id, count(*) AS n FROM corpus GROUP BY 1),
  coh_centre AS (SELECT w.cluster_id, term, sum(weight) / any_value(n) AS m
                 FROM coh w JOIN coh_sizes s ON w.cluster_id = s.cluster_id GROUP BY 1, 2),
  coh_norm AS (SELECT cluster_id, sqrt(sum(m * m)) AS len FROM coh_centre GROUP BY 1),
  coh_cos AS (SELECT w.doc_id, w.cluster_id, sum(weight * m) / any_value(len) AS cosine
              FROM coh w JOIN coh_centre c ON w.cluster_id = c.cluster_id AND w.term = c.term
              JOIN coh_norm l ON w.cluster_id = l.cluster_id GROUP BY 1, 2),
  coherence AS (SELECT s.cluster_id, CASE WHEN any_value(n) <= 1 THEN 0.0
                       ELSE coalesce(sum(cosine), 0) / any_value(n) END AS semantic_coherence
                FROM coh_sizes s LEFT JOIN coh_cos c ON s.cluster_id = c.cluster_id GROUP BY 1)"""

TITLE_SQL = (r"array_to_string(list_transform(regexp_extract_all(k, '(\p{L}+|[^\p{L}]+)'), "
          r"lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), '')")

SQL = {
    "description_clean": f"SELECT doc_id, {sql_description('text')} AS cleaned FROM documents",
    "page_text_clean": f"SELECT page_id, {sql_description('html')} AS cleaned FROM pages",
    "genre_normalize": f"WITH {V.DESCRIBED} SELECT doc_id, {sql_genres('genres')} AS genre_text FROM described",
    "corpus_build": f"WITH {V.DESCRIBED}, {CORPUS} SELECT doc_id, cleaned_text FROM corpus",
    "review_clean": f"SELECT doc_id, {sql_review('text')} AS cleaned FROM documents",
    "conversation_clean": f"SELECT conv_id, turn, {sql_review('text')} AS cleaned FROM conversations",
    "list_split": f"""WITH {V.DESCRIBED}, parts AS (
        SELECT doc_id, list_filter(list_transform(string_split(coalesce(genres, ''), '|'), lambda g: trim(g)),
                                   lambda g: g <> '') AS items FROM described)
        SELECT doc_id, array_to_string(items, ';') AS items, len(items) AS item_count FROM parts""",
    "keyword_filter": f"""SELECT word, count(*) AS uses
        FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS word FROM documents)
        WHERE trim(word) <> '' AND lower(trim(word)) NOT IN ({quoted(K.GENERIC_KEYWORDS)})
          AND regexp_matches(lower(trim(word)), '[a-zA-Z]') GROUP BY 1""",
    "example_clip": """SELECT doc_id, CASE WHEN length(t) > 250 THEN substr(t, 1, 247) || '...' ELSE t END AS example
        FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""",
    "complaint_labels": f"""SELECT p_partkey, CASE WHEN p_size = 7 THEN 'Player complaint' ELSE
        array_to_string(list_transform([p_name, p_brand, p_type], lambda k: {TITLE_SQL}), ' / ') END AS label FROM part""",
    "tfidf_catalog": _sql_report(f"{V.DESCRIBED}, {CORPUS}", "corpus", "doc_id", "cleaned_text", T.CATALOG),
    "tfidf_reviews": _sql_report(f"{V.REVIEWS}, {NEGATIVES}", "negatives", "doc_id", "cleaned_review", T.REVIEWS),
    "tfidf_coherence": _sql_report(f"{V.DESCRIBED}, {CORPUS}", "corpus", "doc_id", "cleaned_text", T.COHERENCE),
    "tfidf_embedding_keywords": _sql_report(
        f"{V.DESCRIBED}, {CORPUS}", "corpus", "doc_id", "cleaned_text", T.EMBEDDING_KEYWORDS),
    "segment_keywords": f"""WITH {V.DESCRIBED}, {CORPUS},
        {sql_tfidf('corpus', 'doc_id', 'cleaned_text', T.CATALOG, 'cluster_id')},
        {sql_keywords('corpus', 'doc_id', 'cluster_id', 12)} SELECT cluster_id, keywords FROM keywords""",
    "segment_coherence": f"""WITH {V.DESCRIBED}, {CORPUS}, {SQL_COHERENCE}
        SELECT cluster_id, round(semantic_coherence, 9) AS semantic_coherence FROM coherence""",
    "pain_point_keywords": f"""WITH {V.REVIEWS}, {NEGATIVES},
        {sql_tfidf('negatives', 'doc_id', 'cleaned_review', T.REVIEWS, 'pain_point_id')},
        {sql_keywords('negatives', 'doc_id', 'pain_point_id', 10)} SELECT pain_point_id, keywords FROM keywords""",
}
