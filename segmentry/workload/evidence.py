"""Concept requests, prompts, replies and title history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.operators import evidence as E
from segmentry.operators import reviews as R
from segmentry.workload import views as V
from segmentry.workload.reviews import TOP_PAINS, _pain_points, segment_pain_points
from segmentry.workload.views import table


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every nation as a scored segment; its customers are the games."""
    return V.event_games(spark, folder).join(table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("app_id"), "c_custkey"), "app_id").groupBy("cluster_id").agg(
        F.concat(F.lit("Nation "), F.first("cluster_id").cast("string")).alias("cluster_name"),
        (F.count(F.lit(1)) / 4).alias("adjusted_opportunity_score"), (F.max("c_custkey") / 8).alias("average_rating"),
        F.count(F.lit(1)).alias("game_count"), F.countDistinct("developer").alias("developer_count"),
        (F.min("c_custkey") / 2).alias("average_chart_position"),
        F.concat_ws(" | ", F.min("game_title"), F.max("game_title")).alias("representative_games"),
        F.concat_ws(" | ", F.min("developer"), F.max("developer")).alias("keywords"),
        F.when(F.count(F.lit(1)) % 2 == 0, F.lit("Even sized.")).alias("signal_summary"))


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a generated title of the user's nation-like segment."""
    return table(spark, folder, "events").select(
        F.concat(F.lit("Nation "), (F.col("user_id") % 25).cast("string")).alias("cluster_name"),
        F.when(F.col("value") > 2, F.concat(F.lit(" T"), F.get_json_object("props", "$.k"), F.lit(" ")))
        .otherwise(F.lit("  ")).alias("title"), F.col("event_id").alias("generated_at"))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    top = R.top_pain_points(segment_pain_points(spark, folder), _pain_points(spark, folder))
    return E.evidence_requests(_scores(spark, folder), top,
                               E.title_history(_titles(spark, folder), key="cluster_name"))


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as a landed reply, in all shapes a reply can take."""
    kind = (F.col("conv_id") + F.col("turn")) % 11
    concept = F.to_json(F.struct(F.concat(F.lit("Title "), F.col("turn").cast("string")).alias("title"),
                                 F.col("text").alias("one_line_pitch")))
    fenced = F.concat(F.lit("```json\nSure: "), concept, F.lit("\n```"))
    choices = F.array(F.struct(F.struct(fenced.alias("content")).alias("message")))
    reply = (F.when(kind == 0, F.to_json(F.struct(concept.alias("response"))))
             .when(kind == 1, F.to_json(F.struct(choices.alias("choices"))))
             .when(kind == 2, F.to_json(F.struct(F.struct(fenced.alias("response")).alias("result"))))
             .when(kind == 3, F.to_json(F.struct(F.struct(choices.alias("choices")).alias("result"))))
             .when(kind == 4, F.to_json(F.struct(concept.alias("output_text"))))
             .when(kind == 5, F.to_json(F.struct(F.struct(concept.alias("output_text")).alias("result"))))
             .when(kind == 6, F.to_json(F.struct(F.struct(F.lit(1).alias("n")).alias("response"))))
             .when(kind == 7, F.to_json(F.struct(F.lit("no json here").alias("response"))))
             .when(kind == 8, F.to_json(F.struct(F.lit("[1, 2]").alias("response"))))
             .when(kind == 9, F.lit('"{\\"title\\": \\"Plain\\"}"')))
    return table(spark, folder, "conversations").select("conv_id", "turn", reply.alias("reply"))


# ---------------------------------------------------------------- queries

def evidence_payload(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.from_json("payload", E.REQUEST)
    rows = _requests(spark, folder).withColumn("p", parsed)
    return rows.select(
        "cluster_id", "concept_style", "p.cluster_name", "p.opportunity_score", "p.average_rating", "p.game_count",
        "p.developer_count", "p.average_chart_position",
        F.array_join("p.representative_games", ",").alias("representative_games"),
        F.array_join("p.keywords", ",").alias("keywords"), "p.signal_summary",
        F.array_join(F.transform("p.pain_points", lambda x: F.concat_ws(
            ":", F.rint(x["share"] * 1000).cast("int").cast("string"), x["keywords"], x["example_reviews"])), ";").alias("pain_points"),
        F.array_join("p.previous_titles", ",").alias("previous_titles"))


def request_validation(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_id") % 5
    bad = (F.when(kind == 1, F.to_json(F.struct(F.lit("").alias("cluster_name"), F.array(F.lit("a")).alias("keywords"))))
           .when(kind == 2, F.to_json(F.struct(F.col("event_type").alias("cluster_name"), F.lit("a").alias("keywords"),
                                               F.array(F.lit("g")).alias("representative_games"))))
           .when(kind == 3, F.lit("{broken")))
    good = F.to_json(F.struct(F.col("event_type").alias("cluster_name"), F.array(F.lit("k")).alias("keywords"),
                              F.array().cast("array<string>").alias("representative_games")))
    events = table(spark, folder, "events").select("event_id", F.coalesce(bad, good).alias("payload"))
    return E.validate_requests(events).select("event_id", "is_valid", "error")


def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of the requests, as the lines that hold evidence."""
    rows = E.render_prompts(_requests(spark, folder))
    lines = F.split("prompt", "\n")
    return rows.select("cluster_id", "concept_style", F.get(lines, F.lit(5)).alias("style"),
                       F.get(lines, F.lit(6)).alias("titles"), F.get(lines, F.lit(7)).alias("segment"),
                       F.get(lines, F.lit(13)).alias("keywords"), F.get(lines, F.lit(14)).alias("games"),
                       F.get(lines, F.lit(15)).alias("signal"))


def reply_text(spark: SparkSession, folder: str) -> DataFrame:
    return replies(spark, folder).select("conv_id", "turn", E.reply_text(F.col("reply")).alias("reply_text"))


def concept_extract(spark: SparkSession, folder: str) -> DataFrame:
    out = E.classify_replies(replies(spark, folder))
    return out.select("conv_id", "turn", F.get_json_object("concept", "$.title").alias("title"),
                      F.get_json_object("concept", "$.one_line_pitch").alias("pitch"))


def reply_status(spark: SparkSession, folder: str) -> DataFrame:
    return E.classify_replies(replies(spark, folder)).groupBy("status").agg(F.count(F.lit(1)).alias("replies"))


def service_reply(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation turn as a landed service body, good and bad."""
    kind = F.col("turn") % 5
    concept = F.struct(F.col("role").alias("title"))
    body = (F.when(kind == 0, F.to_json(F.struct(F.lit(True).alias("success"), concept.alias("concept"))))
            .when(kind == 1, F.to_json(F.struct(F.lit("broke").alias("error"), F.col("role").alias("details"))))
            .when(kind == 2, F.to_json(F.struct(F.lit(False).alias("success"), F.lit("nothing").alias("error"))))
            .when(kind == 3, F.to_json(F.struct(F.lit(True).alias("success"), F.lit("text").alias("concept"))))
            .otherwise("<html>"))
    landed = table(spark, folder, "conversations").select(
        "conv_id", "turn", body.alias("body"), F.when(kind == 1, 502).otherwise(200).alias("http_status"))
    return E.service_results(landed).select("conv_id", "turn", "status", "message", "concept")


def title_history(spark: SparkSession, folder: str) -> DataFrame:
    return E.title_history(_titles(spark, folder), key="cluster_name").select(
        "cluster_name", F.array_join("previous_titles", ",").alias("previous_titles"))


QUERIES = {f.__name__: f for f in (
    evidence_payload, request_validation, prompt_render, reply_text, concept_extract, reply_status,
    service_reply, title_history)}


# ---------------------------------------------------------------- SQL

HISTORY = """firsts AS (SELECT 'Nation ' || (user_id % 25) AS cluster_name,
      'T' || json_extract_string(props, '$.k') AS title, min(event_id) AS used FROM events WHERE value > 2 GROUP BY 1, 2),
  history AS (SELECT cluster_name, list(title ORDER BY used) AS previous_titles FROM (
      SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY used DESC) AS r FROM firsts)
    WHERE r <= 5 GROUP BY 1)"""
REQUESTS = f"""{TOP_PAINS}, {HISTORY},
  nation_scores AS (SELECT c_nationkey AS cluster_id, 'Nation ' || c_nationkey AS cluster_name,
      count(*) / 4 AS opportunity_score, max(c_custkey) / 8 AS average_rating, count(*) AS game_count,
      count(DISTINCT c_mktsegment) AS developer_count, min(c_custkey) / 2 AS average_chart_position,
      min(c_name) || ',' || max(c_name) AS representative_games, min(c_mktsegment) || ',' || max(c_mktsegment) AS keywords,
      CASE WHEN count(*) % 2 = 0 THEN 'Even sized.' ELSE '' END AS signal_summary FROM customer GROUP BY 1),
  nested AS (SELECT cluster_id, string_agg(concat_ws(':', CAST(CAST(round_even(pain_point_share * 1000, 0) AS INTEGER) AS VARCHAR),
      coalesce(keywords, ''), array_to_string(examples, ' | ')), ';' ORDER BY rank) AS pain_points FROM top_pains GROUP BY 1),
  requests AS (SELECT s.*, style AS concept_style, coalesce(pain_points, '') AS pain_points,
      coalesce(array_to_string(previous_titles, ','), '') AS previous_titles
    FROM nation_scores s LEFT JOIN nested n ON s.cluster_id = n.cluster_id
    LEFT JOIN history h ON s.cluster_name = h.cluster_name, (VALUES ('safe'), ('differentiated'), ('bold')) AS v(style))"""
_REPLIES = """replies AS (SELECT conv_id, turn, text, (conv_id + turn) % 11 AS kind FROM conversations)"""
_CONCEPT = """json_object('title', 'Title ' || turn, 'one_line_pitch', text)"""

SQL = {
    "evidence_payload": f"WITH {REQUESTS} SELECT * FROM requests",
    "request_validation": """SELECT event_id, event_id % 5 IN (0, 4) AS is_valid,
        CASE event_id % 5 WHEN 1 THEN 'Missing required market data.' WHEN 2 THEN 'Missing required market data.'
                          WHEN 3 THEN 'Invalid JSON body.' END AS error FROM events""",
    "prompt_render": f"""WITH {REQUESTS}
        SELECT cluster_id, concept_style, 'Style: ' || CASE concept_style
            {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in E.STYLES.items())} END AS style,
          'Titles used before, to be avoided: ' || CASE WHEN previous_titles = '' THEN 'None'
            ELSE replace(previous_titles, ',', ', ') END AS titles,
          'Segment: ' || cluster_name AS segment, 'Keywords: ' || replace(keywords, ',', ', ') AS keywords,
          'Representative games: ' || replace(representative_games, ',', ', ') AS games,
          'Market signal: ' || signal_summary AS signal FROM requests""",
    "concept_extract": f"""WITH {_REPLIES}
        SELECT conv_id, turn, CASE WHEN kind <= 5 THEN 'Title ' || turn WHEN kind = 9 THEN 'Plain' END AS title,
               CASE WHEN kind <= 5 THEN text END AS pitch FROM replies""",
    "reply_status": f"""WITH {_REPLIES}
        SELECT CASE WHEN kind <= 5 OR kind = 9 THEN 'ok' WHEN kind = 6 THEN 'empty' WHEN kind = 7 THEN 'invalid_json'
                    WHEN kind = 8 THEN 'not_an_object' ELSE 'failed' END AS status, count(*) AS replies
        FROM replies GROUP BY 1""",
    "reply_text": f"""WITH {_REPLIES}
        SELECT conv_id, turn, CASE WHEN kind IN (0, 4, 5) THEN CAST({_CONCEPT} AS VARCHAR)
          WHEN kind IN (1, 2, 3) THEN '```json' || chr(10) || 'Sure: ' || CAST({_CONCEPT} AS VARCHAR) || chr(10) || '```'
          WHEN kind = 7 THEN 'no json here' WHEN kind = 8 THEN '[1, 2]' WHEN kind = 9 THEN '{{"title": "Plain"}}'
          ELSE '' END AS reply_text FROM replies""",
    "service_reply": """SELECT conv_id, turn,
        CASE turn % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 4 THEN 'non_json' ELSE 'unexpected' END AS status,
        CASE turn % 5 WHEN 1 THEN role WHEN 2 THEN 'nothing'
          WHEN 3 THEN 'AI service returned an unexpected response.' END AS message,
        CASE WHEN turn % 5 = 0 THEN '{"title":"' || role || '"}' END AS concept FROM conversations""",
    "title_history": f"""WITH {HISTORY}
        SELECT cluster_name, array_to_string(previous_titles, ',') AS previous_titles FROM history""",
}
