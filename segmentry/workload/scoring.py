"""Segment summaries, concentration, score components, labels, ranks and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.functions import constants as K
from segmentry.functions.columns import round_even
from segmentry.operators import clusters, market, naming, scoring
from segmentry.operators import tfidf as T
from segmentry.workload import views as V
from segmentry.workload.text import CORPUS, SQL_COHERENCE, TITLE_SQL, corpus, quoted, sql_keywords, sql_tfidf
from segmentry.workload.views import table

GAME_COLUMNS = ("cluster_id", "title", "developer", "chart_type", "chart_position", "average_rating", "rating_count")
TIE = ("app_id", "chart_type", "entry", "chart_position", "seller")


# ---------------------------------------------------------------- segment tables

def market_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of the charts: statistics, top games, concentration, coherence of titles."""
    charts = V.charts(spark, folder)
    parts = table(spark, folder, "part").select("p_partkey", "p_name", F.col("p_size").alias("cluster_id"))
    weights = T.tfidf(parts, "p_partkey", "p_name", T.COHERENCE, ["cluster_id"])
    summary = (scoring.with_median(scoring.segment_profile(charts), charts)
               .join(scoring.representative_games(charts, 5, TIE), "cluster_id", "left")
               .join(T.cluster_keywords(weights, parts), "cluster_id", "left"))
    return scoring.with_coherence(summary, T.coherence(weights, parts))


def text_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of the described games, everything from the whole texts, which are read once."""
    catalog, coherent = T.fit_all(corpus(spark, folder), "doc_id", "cleaned_text", [T.CATALOG, T.COHERENCE], GAME_COLUMNS)
    docs = catalog.entries
    keywords = T.cluster_keywords(catalog.weights, docs)
    summary = (scoring.with_median(scoring.segment_profile(docs), docs)
               .join(scoring.representative_games(docs, 5, ("doc_id",)), "cluster_id", "left")
               .join(keywords, "cluster_id", "left"))
    return scoring.with_coherence(summary, T.coherence(coherent.weights, coherent.entries))


SCORE_OUTPUT = (
    "opportunity_rank", "cluster_id", "game_count", "developer_count", "top_developer", "top_developer_share",
    "semantic_coherence", *scoring.SCORE_COLUMNS, "opportunity_score", "confidence_level", "segment_type",
    "warning", "signal_summary", "ranking_penalty", "adjusted_opportunity_score")


def market_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.opportunity_scores(market_segments(spark, folder))


# ---------------------------------------------------------------- queries

def segment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.segment_statistics(V.charts(spark, folder))


def representative_games(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.representative_games(V.charts(spark, folder), 5, TIE)


def representative_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = scoring.score_representatives(V.charts(spark, folder))
    return scored.groupBy("app_id").agg(
        F.round(F.min("representative_score"), 9).alias("lowest"),
        F.round(F.max("representative_score"), 9).alias("highest"))


def developer_concentration(spark: SparkSession, folder: str) -> DataFrame:
    out = scoring.developer_concentration(V.charts(spark, folder))
    return out.withColumn("top_developer_share", F.round("top_developer_share", 9))


def min_max_normalize(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").withColumn(
        "size", F.when(F.col("p_size") % 9 != 0, F.col("p_size")))
    out = scoring.min_max_normalize(parts, {
        "price": (F.col("p_retailprice"), True), "size_inverted": (F.col("size"), False),
        "constant": (F.lit(3), True)})
    return out.select("p_partkey", *[F.round(c, 9).alias(c) for c in ("price", "size_inverted", "constant")])


def score_components(spark: SparkSession, folder: str) -> DataFrame:
    unit = scoring.score_components(market_segments(spark, folder))
    return unit.select("cluster_id", *[F.round(c, 6).alias(c) for c in (
        "market_strength", "player_validation", "competition_gap", "developer_diversity",
        "coherence_component", "confidence")])


def opportunity_ranking(spark: SparkSession, folder: str) -> DataFrame:
    out = market_scores(spark, folder).withColumn("top_developer_share", round_even(F.col("top_developer_share"), 6))
    return out.select(*SCORE_OUTPUT)


def text_opportunity_ranking(spark: SparkSession, folder: str) -> DataFrame:
    out = scoring.opportunity_scores(text_segments(spark, folder))
    return out.withColumn("top_developer_share", round_even(F.col("top_developer_share"), 6)).select(
        *SCORE_OUTPUT, "keywords", "representative_games")


def score_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score_breakdown(market_scores(spark, folder)).withColumn("percent", F.round("percent", 6))


def summary_join(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, concentration and coherence of one row per segment each, keys checked."""
    charts = V.charts(spark, folder)
    fitted = T.fit(corpus(spark, folder), "doc_id", "cleaned_text", T.COHERENCE, 0, ["cluster_id"])
    coherence = T.coherence(fitted.weights, fitted.entries)
    joined = scoring.with_concentration(
        scoring.segment_statistics(charts), scoring.developer_concentration(charts), check=True)
    return scoring.with_coherence(joined, coherence, check=True).select(
        "cluster_id", "game_count", "top_developer", F.round("top_developer_share", 9).alias("top_developer_share"),
        F.round("semantic_coherence", 9).alias("semantic_coherence"))


def concept_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return market.concept_candidates(market_scores(spark, folder)).select(
        "cluster_id", "segment_type", "adjusted_opportunity_score")


def segment_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return market.segment_lookup(market_scores(spark, folder), 3).select(
        "cluster_id", "opportunity_rank", "adjusted_opportunity_score", "signal_summary")


def _themed(words: Column) -> Column:
    """Words with a few of them renamed to theme words, so that naming rules apply."""
    for old, new in NAME_WORDS.items():
        words = F.replace(words, F.lit(old), F.lit(new))
    return words


def segment_base_names(spark: SparkSession, folder: str) -> DataFrame:
    """A name per part, from its words, type and brand."""
    words = F.replace(_themed(F.lower("p_name")), F.lit(" "), F.lit(" | "))
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("cluster_id"), F.concat_ws(" | ", words, F.lower("p_type")).alias("keywords"),
        F.col("p_type").alias("representative_games"), F.col("p_brand").alias("top_developer"))
    return naming.with_base_names(rows).select("cluster_id", "keywords", "cluster_name")


def segment_unique_names(spark: SparkSession, folder: str) -> DataFrame:
    """Unique names of the chart segments, many of which share a base name."""
    parts = table(spark, folder, "part").select("p_partkey", "p_name", F.col("p_size").alias("cluster_id"))
    keywords = T.cluster_keywords(T.tfidf(parts, "p_partkey", "p_name", T.COHERENCE, ["cluster_id"]), parts)
    profile = scoring.segment_profile(V.charts(spark, folder)).select("cluster_id", "top_developer")
    rows = profile.join(keywords, "cluster_id").select(
        "cluster_id", "top_developer", _themed(F.col("keywords")).alias("keywords"),
        F.lit("").alias("representative_games"))
    named = naming.unique_names(naming.with_base_names(rows), check=True)
    return named.select("cluster_id", "cluster_name", "keywords", "top_developer")


def stage_facts(spark: SparkSession, folder: str) -> DataFrame:
    charts = V.charts(spark, folder).withColumn("description", F.col("developer"))
    scores = market_scores(spark, folder).withColumn("cluster_name", F.concat(F.lit("S"), F.col("cluster_id")))
    reviews = V.reviews(spark, folder)
    coverage = reviews.groupBy("app_id").agg(F.count(F.lit(1)).alias("reviews_collected"))
    return market.stage_facts(
        charts=charts, enriched=charts, summary=charts.select("cluster_id").distinct(), clustered=charts,
        scores=scores, reviews=reviews, coverage=coverage,
        pain_points=reviews.select("pain_point_id").distinct(), links=charts)


def cluster_sizes(spark: SparkSession, folder: str) -> DataFrame:
    sizes = F.explode(F.array(*[F.lit(k) for k in (3, 4, 5)]))
    labels = table(spark, folder, "events").select("user_id", sizes.alias("k")).withColumn(
        "label", F.col("user_id") % F.col("k"))
    return clusters.cluster_size_profile(labels)


def cluster_count_choice(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.choose_cluster_count(_evaluation(spark, folder))


def cluster_count_choice_sized(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.choose_cluster_count(_evaluation(spark, folder), min_size=10)


def _evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """An evaluation table from the parts: one k per size."""
    return table(spark, folder, "part").groupBy(F.col("p_size").alias("number_of_clusters")).agg(
        F.max("p_retailprice").alias("silhouette_score"), (F.min("p_partkey") % 20).alias("smallest_cluster_size"))


# words of the parts renamed to theme words, so that naming rules apply
NAME_WORDS = {"hot": "merge", "cold": "mansion", "red": "word", "blue": "brain", "small": "hero",
              "large": "manager", "plate": "casino", "ring": "strategy", "old": "action", "bolt": "battle"}

QUERIES = {f.__name__: f for f in (
    segment_summary, representative_games, representative_score, developer_concentration, min_max_normalize,
    score_components, opportunity_ranking, text_opportunity_ranking, score_breakdown, summary_join, concept_candidates,
    segment_lookup, segment_base_names, segment_unique_names, stage_facts, cluster_sizes, cluster_count_choice,
    cluster_count_choice_sized)}


# ---------------------------------------------------------------- SQL

def _statistics(games: str) -> str:
    return f"""stats AS (
      SELECT cluster_id, count(*) AS game_count, count(DISTINCT developer) AS developer_count,
             round_even(avg(average_rating) * 1000, 0) / 1000 AS average_rating,
             round_even(median(rating_count), 0) AS median_rating_count,
             round_even(avg(chart_position) * 100, 0) / 100 AS average_chart_position,
             round_even(avg(CASE WHEN chart_type = 'top_free' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 1000, 0) / 1000
               AS free_game_share
      FROM {games} GROUP BY 1)"""


def _scored(games: str) -> str:
    return f"""scored AS (
      SELECT *, 0.45::DOUBLE * ((101.0 - coalesce(chart_position, 100.0)) / 100) + 0.30::DOUBLE * (coalesce(average_rating, 0.0) / 5)
             + 0.25::DOUBLE * CASE WHEN max(lg) OVER (PARTITION BY cluster_id) > 0
                           THEN lg / max(lg) OVER (PARTITION BY cluster_id) ELSE lg END AS score
      FROM (SELECT *, ln(1 + coalesce(rating_count, 0.0)) AS lg FROM {games}))"""


def _representatives(games: str, tie: str) -> str:
    return f"""{_scored(games)},
    reps AS (SELECT cluster_id, string_agg(title, ' | ' ORDER BY r) AS representative_games FROM (
      SELECT cluster_id, title, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 12) DESC, {tie}) AS r
      FROM scored) WHERE r <= 5 GROUP BY 1)"""


def _concentration(games: str) -> str:
    return f"""conc AS (
      SELECT cluster_id, top_developer, n / total AS top_developer_share FROM (
        SELECT cluster_id, coalesce(developer, 'Unknown') AS top_developer, count(*) AS n,
               sum(count(*)) OVER (PARTITION BY cluster_id) AS total,
               row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, coalesce(developer, 'Unknown')) AS r
        FROM {games} GROUP BY 1, 2) WHERE r = 1)"""


def _unit(value: str, better: bool) -> str:
    base = (f"coalesce(CASE WHEN max({value}) OVER () = min({value}) OVER () OR min({value}) OVER () IS NULL THEN 0.5::DOUBLE "
            f"ELSE ({value} - min({value}) OVER ()) / (max({value}) OVER () - min({value}) OVER ()) END, 0.5)")
    return base if better else f"(1.0 - {base})"


_CLIP = "greatest(least({}, 1.0::DOUBLE), 0.0::DOUBLE)".format
SQL_SCORES = f"""units AS (
    SELECT *, {_unit('average_chart_position', False)} AS market_strength,
      0.65::DOUBLE * {_unit('average_rating', True)}
        + 0.35::DOUBLE * {_unit('ln(1 + coalesce(median_rating_count, 0.0))', True)} AS player_validation,
      {_CLIP(f"(0.55::DOUBLE * {_unit('game_count', False)} + 0.45::DOUBLE * {_unit('developer_count', False)}) * (1.0 - 0.80::DOUBLE * top_developer_share)")}
        AS competition_gap,
      {_CLIP('1.0 - top_developer_share')} AS developer_diversity,
      {_unit('semantic_coherence', True)} AS coherence_component,
      {_CLIP('game_count / 15')} AS confidence FROM segments),
  weighted AS (SELECT *, market_strength * 25 AS ms, player_validation * 20 AS pv, competition_gap * 15 AS cg,
      developer_diversity * 15 AS dd, coherence_component * 15 AS sc, confidence * 10 AS cf FROM units),
  rounded AS (SELECT * EXCLUDE (semantic_coherence), round_even(semantic_coherence * 1000, 0) / 1000 AS semantic_coherence,
      round_even((ms + pv + cg + dd + sc + cf) * 10, 0) / 10 AS opportunity_score,
      round_even(ms * 10, 0) / 10 AS market_strength_score, round_even(pv * 10, 0) / 10 AS player_validation_score,
      round_even(cg * 10, 0) / 10 AS competition_gap_score, round_even(dd * 10, 0) / 10 AS developer_diversity_score,
      round_even(sc * 10, 0) / 10 AS semantic_coherence_score, round_even(cf * 10, 0) / 10 AS confidence_score
    FROM weighted),
  labelled AS (SELECT *,
      CASE WHEN game_count >= 15 AND developer_count >= 8 AND semantic_coherence >= 0.25 THEN 'High'
           WHEN game_count >= 7 AND developer_count >= 4 AND semantic_coherence >= 0.15 THEN 'Medium'
           ELSE 'Low' END AS confidence_level,
      CASE WHEN top_developer_share >= 0.5 THEN '{K.FRANCHISE_TYPE}' WHEN semantic_coherence < 0.15 THEN '{K.MIXED_TYPE}'
           WHEN game_count >= 20 AND competition_gap_score < 7 THEN '{K.ESTABLISHED_TYPE}'
           ELSE '{K.CANDIDATE_TYPE}' END AS segment_type,
      concat_ws('; ', CASE WHEN top_developer_share >= 0.5 THEN '{K.CONCENTRATION_WARNING}' END,
                CASE WHEN semantic_coherence < 0.15 THEN '{K.COHERENCE_WARNING}' END,
                CASE WHEN game_count < 5 THEN '{K.SIZE_WARNING}' END) AS warning,
      concat_ws('; ', {', '.join(f"CASE WHEN {c} >= {least} THEN '{text}' END" for c, least, text in K.SIGNALS)}) AS signals
    FROM rounded),
  penalized AS (SELECT *, CASE WHEN signals = '' THEN '{K.NO_SIGNAL}'
        ELSE upper(substr(signals, 1, 1)) || lower(substr(signals, 2)) || '.' END AS signal_summary,
      CASE segment_type WHEN '{K.FRANCHISE_TYPE}' THEN 15.0 WHEN '{K.MIXED_TYPE}' THEN 20.0 ELSE 0.0 END::DOUBLE AS ranking_penalty
    FROM labelled),
  adjusted AS (SELECT *, round_even(greatest(opportunity_score - ranking_penalty, 0.0) * 10, 0) / 10
      AS adjusted_opportunity_score FROM penalized),
  scores AS (SELECT *, CAST(row_number() OVER (ORDER BY adjusted_opportunity_score DESC, cluster_id) AS INTEGER)
      AS opportunity_rank FROM adjusted)"""

_TIE_SQL = ", ".join(TIE)
# coherence of the part names, in the same form as that of the corpus
_PART_COHERENCE = SQL_COHERENCE.replace("corpus", "part_docs").replace("cleaned_text", "p_name").replace("doc_id", "p_partkey")
MARKET_SEGMENTS = f"""{V.CHARTS}, {_statistics('charts')}, {_concentration('charts')},
  part_docs AS (SELECT p_partkey, p_name, p_size AS cluster_id FROM part), {_PART_COHERENCE},
  segments AS (SELECT s.*, c.top_developer, c.top_developer_share, h.semantic_coherence FROM stats s
    LEFT JOIN conc c ON s.cluster_id = c.cluster_id LEFT JOIN coherence h ON s.cluster_id = h.cluster_id)"""
_SHARE = "round_even(top_developer_share * 1000000, 0) / 1000000 AS top_developer_share"
_OUT = ", ".join(_SHARE if c == "top_developer_share" else c for c in SCORE_OUTPUT)

def _themed_sql(words: str) -> str:
    for old, new in NAME_WORDS.items():
        words = f"replace({words}, '{old}', '{new}')"
    return words


def _naming_sql(rows: str) -> str:
    """CTE `named`(cluster_id, keywords, top_developer, useful, base) from `rows`."""
    lower = "lower(array_to_string(ks, ' ') || ' ' || coalesce(representative_games, '') || ' ' || coalesce(top_developer, ''))"
    votes = ", ".join(f"{{'score': len(list_intersect(toks, [{quoted(words)}])), 'name': '{name}'}}"
                      for name, words in K.THEMES.items())
    rules = " ".join("WHEN " + " AND ".join(f"list_contains(names, '{t}')" for t in themes) + f" THEN '{label}'"
                     for themes, label in K.THEME_NAMES)
    franchise = " ".join(
        "WHEN " + " OR ".join([f"contains(txt, '{p.replace(chr(39), chr(39) * 2)}')" for p in in_text]
                              + [f"contains(lower(top_developer), '{p}')" for p in in_dev])
        + f" THEN '{label.replace(chr(39), chr(39) * 2)}'" for label, in_text, in_dev in K.FRANCHISES)
    def title(word: str) -> str:
        return TITLE_SQL.replace("regexp_extract_all(k,", f"regexp_extract_all({word},")

    return f"""n1 AS (SELECT *, list_filter(list_transform(string_split(keywords, '|'), lambda k: lower(trim(k))), lambda k: k <> '') AS ks FROM {rows}),
      n2 AS (SELECT *, {lower} AS txt, list_filter(ks, lambda k: k NOT IN ({quoted(K.GENERIC_KEYWORDS)})
             AND regexp_matches(k, '[a-zA-Z]')) AS useful FROM n1),
      n3 AS (SELECT *, list_distinct(string_split_regex(translate(txt, '/·,.', '    '), '\\s+')) AS toks FROM n2),
      n4 AS (SELECT *, list_reverse_sort(list_filter([{votes}], lambda v: v.score > 0)) AS votes FROM n3),
      n5 AS (SELECT *, list_transform(votes, lambda v: v.name) AS names, useful[1] AS w1,
             list_filter(useful, lambda k: NOT contains(k, useful[1]) AND NOT contains(useful[1], k))[1] AS w2 FROM n4),
      named AS (SELECT *, CASE {franchise} {rules}
          WHEN len(names) >= 2 THEN names[1] || ' & ' || names[2] || ' Games' WHEN len(names) = 1 THEN names[1] || ' Games'
          WHEN w2 IS NOT NULL THEN {title('w1')} || ' & ' || {title('w2')} || ' Games'
          WHEN w1 IS NOT NULL THEN {title('w1')} || ' Games' ELSE 'Game Segment ' || cluster_id END AS base FROM n5)"""


SQL = {
    "segment_base_names": f"""WITH part_rows AS (SELECT p_partkey AS cluster_id, p_type AS representative_games, p_brand AS top_developer,
          replace({_themed_sql('lower(p_name)')}, ' ', ' | ') || ' | ' || lower(p_type) AS keywords FROM part),
        {_naming_sql('part_rows')} SELECT cluster_id, keywords, base AS cluster_name FROM named""",
    "segment_unique_names": f"""WITH RECURSIVE {V.CHARTS}, {_concentration('charts')},
        part_docs AS (SELECT p_partkey, p_name, p_size AS cluster_id FROM part),
        {sql_tfidf('part_docs', 'p_partkey', 'p_name', T.COHERENCE, 'cluster_id')},
        {sql_keywords('part_docs', 'p_partkey', 'cluster_id', 12)},
        seg_rows AS (SELECT c.cluster_id, top_developer, '' AS representative_games, {_themed_sql('keywords')} AS keywords
                     FROM conc c JOIN keywords k ON c.cluster_id = k.cluster_id),
        {_naming_sql('seg_rows')},
        holders AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY cluster_id) AS i,
            list_transform(useful, lambda k: {TITLE_SQL} || ' · ' || base) AS options FROM named),
        fold AS (SELECT base, i, cluster_id, base AS cluster_name, [base] AS used FROM holders WHERE i = 1
          UNION ALL
          SELECT base, i, cluster_id, pick, list_append(used, pick) FROM (
            SELECT h.base, h.i, h.cluster_id, f.used, coalesce(list_filter(h.options, lambda o: NOT list_contains(f.used, o))[1],
                   h.base || ' (Segment ' || h.cluster_id || ')') AS pick
            FROM fold f JOIN holders h ON h.base = f.base AND h.i = f.i + 1))
        SELECT f.cluster_id, cluster_name, keywords, top_developer FROM fold f JOIN seg_rows s ON f.cluster_id = s.cluster_id""",
    "segment_summary": f"WITH {V.CHARTS}, {_statistics('charts')} SELECT * FROM stats",
    "representative_games": f"WITH {V.CHARTS}, {_representatives('charts', _TIE_SQL)} SELECT * FROM reps",
    "representative_score": f"""WITH {V.CHARTS}, {_scored('charts')}
        SELECT app_id, round(min(score), 9) AS lowest, round(max(score), 9) AS highest FROM scored GROUP BY 1""",
    "developer_concentration": f"""WITH {V.CHARTS}, {_concentration('charts')}
        SELECT cluster_id, top_developer, round(top_developer_share, 9) AS top_developer_share FROM conc""",
    "min_max_normalize": f"""WITH p AS (SELECT *, CASE WHEN p_size % 9 <> 0 THEN p_size END AS size FROM part)
        SELECT p_partkey, round({_unit('p_retailprice', True)}, 9) AS price,
               round({_unit('size', False)}, 9) AS size_inverted, 0.5::DOUBLE AS constant FROM p""",
    "score_components": f"""WITH {MARKET_SEGMENTS}, {SQL_SCORES}
        SELECT cluster_id, round(market_strength, 6) AS market_strength, round(player_validation, 6) AS player_validation,
               round(competition_gap, 6) AS competition_gap, round(developer_diversity, 6) AS developer_diversity,
               round(coherence_component, 6) AS coherence_component, round(confidence, 6) AS confidence FROM units""",
    "opportunity_ranking": f"WITH {MARKET_SEGMENTS}, {SQL_SCORES} SELECT {_OUT} FROM scores",
    "text_opportunity_ranking": f"""WITH {V.DESCRIBED}, {CORPUS}, {_statistics('corpus')}, {_concentration('corpus')},
        {SQL_COHERENCE}, {sql_tfidf('corpus', 'doc_id', 'cleaned_text', T.CATALOG, 'cluster_id')},
        {sql_keywords('corpus', 'doc_id', 'cluster_id', 12)}, {_representatives('corpus', 'doc_id')},
        segments AS (SELECT s.*, c.top_developer, c.top_developer_share, h.semantic_coherence, k.keywords,
            r.representative_games FROM stats s
          LEFT JOIN conc c ON s.cluster_id = c.cluster_id LEFT JOIN coherence h ON s.cluster_id = h.cluster_id
          LEFT JOIN keywords k ON s.cluster_id = k.cluster_id LEFT JOIN reps r ON s.cluster_id = r.cluster_id),
        {SQL_SCORES} SELECT {_OUT}, keywords, representative_games FROM scores""",
    "score_breakdown": f"""WITH {MARKET_SEGMENTS}, {SQL_SCORES}
        SELECT cluster_id, component, score, CAST(maximum AS INTEGER) AS maximum, round(100 * score / maximum, 6) AS percent FROM (
          {' UNION ALL '.join(f"SELECT cluster_id, '{n}_score' AS component, {n}_score AS score, {w} AS maximum FROM scores" for n, w in K.SCORE_WEIGHTS.items())})""",
    "summary_join": f"""WITH {V.CHARTS}, {_concentration('charts')}, {V.DESCRIBED}, {CORPUS}, {SQL_COHERENCE}
        SELECT s.cluster_id, game_count, top_developer, round(top_developer_share, 9) AS top_developer_share,
               round(semantic_coherence, 9) AS semantic_coherence
        FROM (SELECT cluster_id, count(*) AS game_count FROM charts GROUP BY 1) s
        LEFT JOIN conc c ON s.cluster_id = c.cluster_id LEFT JOIN coherence h ON s.cluster_id = h.cluster_id""",
    "concept_candidates": f"""WITH {MARKET_SEGMENTS}, {SQL_SCORES}
        SELECT cluster_id, segment_type, adjusted_opportunity_score FROM scores WHERE segment_type <> '{K.MIXED_TYPE}'""",
    "segment_lookup": f"""WITH {MARKET_SEGMENTS}, {SQL_SCORES}
        SELECT cluster_id, opportunity_rank, adjusted_opportunity_score, signal_summary FROM scores WHERE cluster_id = 3""",
    "stage_facts": f"""WITH {MARKET_SEGMENTS}, {SQL_SCORES}, {V.REVIEWS}
        SELECT 'collect' AS stage, 'rows_collected' AS fact, CAST(count(*) AS VARCHAR) AS value FROM charts
        UNION ALL SELECT 'collect', 'top_free', CAST(count(*) AS VARCHAR) FROM charts WHERE chart_type = 'top_free'
        UNION ALL SELECT 'collect', 'top_paid', CAST(count(*) AS VARCHAR) FROM charts WHERE chart_type = 'top_paid'
        UNION ALL SELECT 'enrich', 'unique_games', CAST(count(DISTINCT app_id) AS VARCHAR) FROM charts
        UNION ALL SELECT 'enrich', 'developers', CAST(count(DISTINCT developer) AS VARCHAR) FROM charts
        UNION ALL SELECT 'enrich', 'descriptions', CAST(count(developer) AS VARCHAR) FROM charts
        UNION ALL SELECT 'cluster', 'segments_discovered', CAST(count(DISTINCT cluster_id) AS VARCHAR) FROM charts
        UNION ALL SELECT 'cluster', 'games_segmented', CAST(count(DISTINCT app_id) AS VARCHAR) FROM charts
        UNION ALL SELECT 'opportunities', 'segments_ranked', CAST(count(*) AS VARCHAR) FROM scores
        UNION ALL SELECT 'opportunities', 'top_signal', 'S' || cluster_id FROM scores WHERE opportunity_rank = 1
        UNION ALL SELECT 'opportunities', 'top_score', printf('%.1f/100', adjusted_opportunity_score) FROM scores
                  WHERE opportunity_rank = 1
        UNION ALL SELECT 'reviews', 'reviews_collected', CAST(count(*) AS VARCHAR) FROM reviews
        UNION ALL SELECT 'reviews', 'negative_reviews', CAST(count(*) AS VARCHAR) FROM reviews WHERE review_rating IN ('1', '2')
        UNION ALL SELECT 'reviews', 'apps_with_reviews', CAST(count(DISTINCT app_id) AS VARCHAR) FROM reviews
        UNION ALL SELECT 'pain_points', 'pain_point_groups', CAST(count(DISTINCT pain_point_id) AS VARCHAR) FROM reviews
        UNION ALL SELECT 'pain_points', 'segments_with_review_evidence', CAST(count(DISTINCT cluster_id) AS VARCHAR) FROM charts""",
    "cluster_sizes": """SELECT k, min(n) AS smallest_cluster_size, max(n) AS largest_cluster_size FROM (
          SELECT k, user_id % k AS label, count(*) AS n FROM events, (VALUES (3), (4), (5)) AS v(k) GROUP BY 1, 2)
        GROUP BY 1""",
    "cluster_count_choice": """WITH e AS (SELECT p_size AS k, max(p_retailprice) AS s FROM part GROUP BY 1)
        SELECT k AS number_of_clusters, s AS silhouette_score FROM e
        WHERE s >= 0.95::DOUBLE * (SELECT max(s) FROM e) ORDER BY k LIMIT 1""",
    "cluster_count_choice_sized": """WITH e AS (SELECT p_size AS k, max(p_retailprice) AS s, min(p_partkey) % 20 AS m
          FROM part GROUP BY 1), ok AS (SELECT * FROM e WHERE m >= 10 OR NOT EXISTS (SELECT 1 FROM e WHERE m >= 10))
        SELECT k AS number_of_clusters, s AS silhouette_score FROM ok
        WHERE s >= 0.95::DOUBLE * (SELECT max(s) FROM ok) ORDER BY k LIMIT 1""",
}
