"""Concept evidence: request payloads, validation, prompts, reply parsing, titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentry.functions.columns import split_list
from segmentry.operators.rows import first_per_key, top_per_key

# Concept styles and what each asks for.
STYLES = {
    "safe": "Keep to mechanics that already work in this segment; feasibility comes first.",
    "differentiated": "Build on proven mechanics and add one clear twist that sets the concept apart.",
    "bold": "Combine proven signals of the market in an unexpected but believable way.",
}
DEFAULT_STYLE = "differentiated"

# The fields a concept reply must hold.
CONCEPT_FIELDS = (
    "title", "one_line_pitch", "genre", "target_audience", "core_mechanic", "core_loop",
    "unique_twist", "pain_points_addressed", "retention_ideas", "monetization",
    "market_rationale", "main_risk", "originality_score",
)

# Places a reply may keep its text, first string wins.
REPLY_PATHS = (
    "$.response", "$.choices[0].message.content", "$.result.response",
    "$.result.choices[0].message.content", "$.output_text", "$.result.output_text",
)

REQUEST = (
    "cluster_name string, opportunity_score double, average_rating double, game_count long, "
    "developer_count long, average_chart_position double, representative_games array<string>, "
    "keywords array<string>, signal_summary string, "
    "pain_points array<struct<share:double,keywords:string,example_reviews:string>>, "
    "concept_style string, previous_titles array<string>"
)


# Messages that results carry.
INVALID_BODY = "Invalid JSON body."
MISSING_DATA = "Missing required market data."
UNEXPECTED_REPLY = "AI service returned an unexpected response."


def title_history(titles: DataFrame, key: str = "segment", title: str = "title",
                  at: str = "generated_at", keep: int = 5) -> DataFrame:
    """Last `keep` distinct titles of each segment, oldest first.

    A title counts from its first use. Repeats fall away before the ranking, so
    a segment with many copies sends few rows.
    """
    clean = (titles.withColumn(title, F.btrim(F.col(title), F.lit(" \t\n\r\f\u000b")))
             .filter(F.length(title) > 0))
    first = clean.groupBy(key, title).agg(F.min(at).alias(at))
    last = top_per_key(first, [key], [F.desc(at), F.desc(title)], keep)
    return (last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, title))).alias("t"))
            .select(key, F.col(f"t.{title}").alias("previous_titles")))


def evidence_requests(scores: DataFrame, pain_points: DataFrame, titles: DataFrame | None = None,
                      styles: Sequence[str] = tuple(STYLES)) -> DataFrame:
    """One request per segment and style: cluster_id, concept_style, payload (JSON).

    `pain_points` comes from `top_pain_points`; `titles` is (cluster_name, previous_titles).
    """
    nested = pain_points.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.struct(F.col("pain_point_share").alias("share"), F.coalesce("keywords", F.lit("")).alias("keywords"),
                         F.array_join("example_reviews", " | ").alias("example_reviews")).alias("p")))).alias("i"))
    rows = scores.join(nested.select("cluster_id", F.col("i.p").alias("pain_points")), "cluster_id", "left")
    if titles is None:
        rows = rows.withColumn("previous_titles", F.array().cast("array<string>"))
    else:
        rows = rows.join(titles.select("cluster_name", "previous_titles"), "cluster_name", "left")
    styled = rows.withColumn("concept_style", F.explode(F.array(*[F.lit(s) for s in styles])))
    empty = F.array().cast("array<string>")
    return styled.select("cluster_id", "concept_style", F.to_json(F.struct(
        "cluster_name", F.col("adjusted_opportunity_score").alias("opportunity_score"), "average_rating",
        "game_count", "developer_count", "average_chart_position",
        split_list(F.col("representative_games")).alias("representative_games"),
        split_list(F.col("keywords")).alias("keywords"),
        F.coalesce("signal_summary", F.lit("")).alias("signal_summary"),
        F.coalesce("pain_points", F.array().cast(
            "array<struct<share:double,keywords:string,example_reviews:string>>")).alias("pain_points"),
        "concept_style", F.coalesce("previous_titles", empty).alias("previous_titles"))).alias("payload"))


_END = "@end@"


def whole_json(text: Column) -> Column:
    """`[value, end mark]` as a variant if the whole text is one JSON value, else null.

    The parser reads one value and ignores what follows; the end mark behind the text shows that nothing did.
    """
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    return F.when(F.try_variant_get(parsed, "$[1]", "string") == _END, parsed)


def _kind(parsed: Column, path: str = "$") -> Column:
    """Type of the value at `path` of a `whole_json`: OBJECT.., ARRAY.., STRING, BOOLEAN, a number; null if absent."""
    return F.schema_of_variant(F.try_variant_get(parsed, f"$[0]{path[1:]}", "variant"))


def _is(parsed: Column, kind: str, path: str = "$") -> Column:
    return F.coalesce(F.startswith(_kind(parsed, path), F.lit(kind)), F.lit(False))


def validate_requests(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `is_valid` and `error`: a body that is one JSON object, a name that is not empty, 0 or false, both lists."""
    p = whole_json(F.col(payload))
    text = F.coalesce(F.get_json_object(F.col(payload), "$.cluster_name"), F.lit(""))
    number = F.coalesce(F.try_variant_get(p, "$[0].cluster_name", "double") != 0, F.lit(True))
    kind = F.coalesce(_kind(p, "$.cluster_name"), F.lit("VOID"))
    named = (F.when(kind == "VOID", False).when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true")
             .when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), True).otherwise(number))
    complete = named & _is(p, "ARRAY", "$.representative_games") & _is(p, "ARRAY", "$.keywords")
    error = F.when(~_is(p, "OBJECT"), INVALID_BODY).when(~complete, MISSING_DATA)
    return requests.withColumn("error", error).withColumn("is_valid", F.col("error").isNull())


def render_prompts(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """Add `prompt`, the text for the model, with defaults where evidence is missing."""
    r = F.from_json(F.col(payload), REQUEST)

    def number(name: str) -> Column:
        return F.coalesce(r[name].cast("string"), F.lit("unknown"))

    def listed(name: str) -> Column:
        return F.coalesce(F.array_join(r[name], ", "), F.lit(""))

    style = F.coalesce(r["concept_style"], F.lit(DEFAULT_STYLE))
    wish = F.lit(STYLES[DEFAULT_STYLE])
    for name, text in STYLES.items():
        wish = F.when(style == name, text).otherwise(wish)
    complaints = F.when(F.size(r["pain_points"]) > 0, F.to_json(r["pain_points"])).otherwise(
        F.lit("No reliable review pain points available."))
    titles = F.when(F.size(r["previous_titles"]) > 0, listed("previous_titles")).otherwise(F.lit("None"))
    lines = [
        F.lit("Design one original mobile game from the market evidence below."),
        F.lit("Rely on this evidence only; invent no figures, copy no existing game, brand or character."),
        F.lit("Answer with a single JSON object and nothing else."),
        F.concat(F.lit("Fields: "), F.lit(", ".join(CONCEPT_FIELDS))),
        F.lit("originality_score is a whole number from 0 to 100."),
        F.concat(F.lit("Style: "), wish),
        F.concat(F.lit("Titles used before, to be avoided: "), titles),
        F.concat(F.lit("Segment: "), F.coalesce(r["cluster_name"], F.lit(""))),
        F.concat(F.lit("Opportunity score: "), number("opportunity_score"), F.lit("/100")),
        F.concat(F.lit("Average rating: "), number("average_rating")),
        F.concat(F.lit("Ranked games: "), number("game_count")),
        F.concat(F.lit("Developers: "), number("developer_count")),
        F.concat(F.lit("Average chart position: "), number("average_chart_position")),
        F.concat(F.lit("Keywords: "), listed("keywords")),
        F.concat(F.lit("Representative games: "), listed("representative_games")),
        F.concat(F.lit("Market signal: "), F.coalesce(r["signal_summary"], F.lit("Not available"))),
        F.concat(F.lit("Player complaints: "), complaints),
    ]
    return requests.withColumn("prompt", F.concat_ws("\n", *lines))


def _string_at(parsed: Column, path: str) -> Column:
    """Text at `path` of a `whole_json`, only where the value there is a string."""
    return F.when(_kind(parsed, path) == "STRING", F.try_variant_get(parsed, f"$[0]{path[1:]}", "string"))


def reply_text(reply: Column) -> Column:
    """Text of a model reply (JSON): the reply itself if a string, else the first known place."""
    parsed = whole_json(reply)
    return F.coalesce(*[_string_at(parsed, p) for p in ("$", *REPLY_PATHS)], F.lit(""))


def extract_object(text: Column) -> Column:
    """JSON object inside a text: code fences removed, first `{` to last `}`; null if it does not parse."""
    blank = F.lit(" \t\n\r\f\u000b")
    trimmed = F.btrim(text, blank)
    bare = F.regexp_replace(F.regexp_replace(trimmed, r"(?i)\A```(?:json)?", ""), r"```\z", "")
    cleaned = F.when(F.startswith(trimmed, F.lit("```")), F.btrim(bare, blank)).otherwise(trimmed)
    first = F.instr(cleaned, "{")
    last = F.length(cleaned) - F.instr(F.reverse(cleaned), "}") + 1
    sliced = F.when((first > 0) & F.contains(cleaned, F.lit("}")) & (last > first),
                    F.substr(cleaned, first, last - first + 1)).otherwise(cleaned)
    return F.when(whole_json(sliced).isNotNull(), sliced)


def classify_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Add `reply_text`, `concept` and `status` (ok, failed, empty, invalid_json, not_an_object).

    A null reply is a failed call.
    """
    out = (replies.withColumn("reply_text", reply_text(F.col(reply)))
           .withColumn("__json", extract_object(F.col("reply_text"))))
    is_object = _is(whole_json(F.col("__json")), "OBJECT")
    status = (F.when(F.col(reply).isNull(), "failed").when(F.col("reply_text") == "", "empty")
              .when(F.col("__json").isNull(), "invalid_json").when(~is_object, "not_an_object")
              .otherwise("ok"))
    return (out.withColumn("status", status)
            .withColumn("concept", F.when(F.col("status") == "ok", F.col("__json"))).drop("__json"))


def service_results(bodies: DataFrame, body: str = "body", http_status: str = "http_status") -> DataFrame:
    """Add `status`, `message` and `concept` to landed service bodies.

    ok: success is set and the concept is an object. failed: the request was refused
    (message from details, error or the code). non_json and unexpected otherwise.
    """
    b, code = F.col(body), F.col(http_status)
    parsed = whole_json(b)
    concept = F.get_json_object(b, "$.concept")
    success = ~F.coalesce(F.get_json_object(b, "$.success"), F.lit("")).isin("", "false", "0")
    good = success & _is(parsed, "OBJECT", "$.concept")

    def text(path: str) -> Column:
        return F.nullif(F.get_json_object(b, path), F.lit(""))

    refused = ~code.between(200, 399)
    status = (F.when(~_is(parsed, "OBJECT"), "non_json").when(refused, "failed")
              .when(good, "ok").otherwise("unexpected"))
    out = bodies.withColumn("status", status)
    message = (F.when(F.col("status") == "failed", F.coalesce(
        text("$.details"), text("$.error"), F.concat(F.lit("HTTP "), code.cast("string"))))
        .when(F.col("status") == "unexpected", F.coalesce(
            F.get_json_object(b, "$.error"), F.lit(UNEXPECTED_REPLY))))
    return (out.withColumn("message", message)
            .withColumn("concept", F.when(F.col("status") == "ok", concept)))


def new_titles(replies: DataFrame, segment: str = "segment", at: str = "generated_at") -> DataFrame:
    """(segment, title, generated_at) of the accepted concepts, first use of each title."""
    titled = replies.filter(F.col("status") == "ok").select(
        segment, F.trim(F.get_json_object("concept", "$.title")).alias("title"), at)
    return first_per_key(titled.filter(F.length("title") > 0), [segment, "title"], [at])
