"""Segment summary, concentration, normalisation, scores, labels and rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry.contracts import assert_unique, require_columns
from segmentry.functions import constants as K
from segmentry.functions.columns import clip01, round_even, to_number
from segmentry.functions.text import capitalize
from segmentry.operators.rows import lookup_join, per_segment, top_per_key

SUMMARY_COLUMNS = (
    "cluster_id", "game_count", "developer_count", "average_rating", "median_rating_count",
    "average_chart_position", "keywords", "representative_games",
)
SCORE_COLUMNS = tuple(f"{name}_score" for name in K.SCORE_WEIGHTS)


def segment_profile(games: DataFrame) -> DataFrame:
    """One row per segment: statistics without the median, and the largest developer.

    Rows combine to one per (segment, developer) before they reach a segment's
    group. Missing developers count as `Unknown` in the shares but not as developers.
    """
    rating, position = to_number(F.col("average_rating")), to_number(F.col("chart_position"))
    per_developer = games.groupBy(
        "cluster_id", F.coalesce("developer", F.lit("Unknown")).alias("developer_name")).agg(
        F.count(F.lit(1)).alias("n"), F.count("developer").alias("named"),
        F.sum(rating).alias("rating_sum"), F.count(rating).alias("rated"),
        F.sum(position).alias("position_sum"), F.count(position).alias("placed"),
        F.count_if(F.col("chart_type") == "top_free").alias("free"))
    # least of (-n, name): most games first, then the alphabet
    top = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col("developer_name").alias("name")))
    rows = per_developer.groupBy("cluster_id").agg(
        F.sum("n").alias("game_count"), F.count_if(F.col("named") > 0).alias("developer_count"),
        F.sum("rating_sum").alias("rating_sum"), F.sum("rated").alias("rated"),
        F.sum("position_sum").alias("position_sum"), F.sum("placed").alias("placed"),
        F.sum("free").alias("free"), top.alias("top"))
    none = F.lit(0)
    return rows.select(
        "cluster_id", "game_count", "developer_count",
        round_even(F.col("rating_sum") / F.nullif("rated", none), 3).alias("average_rating"),
        round_even(F.col("position_sum") / F.nullif("placed", none), 2).alias("average_chart_position"),
        round_even(F.col("free") / F.col("game_count"), 3).alias("free_game_share"),
        F.col("top.name").alias("top_developer"),
        (-F.col("top.minus_n") / F.col("game_count")).alias("top_developer_share"))


def segment_statistics(games: DataFrame) -> DataFrame:
    """Size, developers, mean rating, median rating count, mean position, free share."""
    return with_median(segment_profile(games).drop("top_developer", "top_developer_share"), games)


def with_median(summary: DataFrame, games: DataFrame) -> DataFrame:
    """Summary with the median rating count of its segments."""
    counts = games.select("cluster_id", to_number(F.col("rating_count")).alias("ratings"))
    medians = grouped_median(counts, "cluster_id", "ratings", "median_rating_count")
    return lookup_join(summary, medians, "cluster_id").withColumn(
        "median_rating_count", round_even(F.col("median_rating_count"), 0))


def grouped_median(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Exact median per key without gathering a key in one task.

    Values are counted per (key, value); a coarse logarithmic bucket locates the
    middle ranks from bucket sizes alone, and only the values of that bucket are
    then put in order.
    """
    magnitude = F.floor(F.log1p(F.abs(value)) * 16)
    counts = (df.filter(F.col(value).isNotNull()).groupBy(key, value)
              .agg(F.count(F.lit(1)).alias("n"))
              .withColumn("bucket", F.when(F.col(value) < 0, -magnitude).otherwise(magnitude)))
    by_bucket = Window.partitionBy(key).orderBy("bucket")
    whole = Window.partitionBy(key)
    located = (counts.groupBy(key, "bucket").agg(F.sum("n").alias("size"))
               .withColumn("before", F.sum("size").over(by_bucket) - F.col("size"))
               .withColumn("total", F.sum("size").over(whole))
               .withColumn("low", F.floor((F.col("total") + 1) / 2))
               .withColumn("high", F.floor(F.col("total") / 2) + 1)
               .filter((F.col("before") < F.col("high")) & (F.col("before") + F.col("size") >= F.col("low")))
               .select(key, "bucket", "before", "low", "high"))
    inside = counts.join(located, [key, "bucket"])
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(key, "bucket").orderBy(value))
    placed = inside.withColumn("upto", upto)

    def holds(rank: str) -> Column:
        return (F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("n") < F.col(rank))

    return placed.groupBy(key).agg(
        ((F.max(F.when(holds("low"), F.col(value))) + F.max(F.when(holds("high"), F.col(value)))) / 2).alias(name))


def representative_score(position: Column, rating: Column, log_count: Column,
                         max_log_count: Column) -> Column:
    """0.45 position + 0.30 rating + 0.25 rating volume relative to the segment."""
    volume = F.when(max_log_count > 0, log_count / max_log_count).otherwise(log_count)
    return (0.45 * ((F.lit(101.0) - F.coalesce(position, F.lit(100.0))) / 100)
            + 0.30 * (F.coalesce(rating, F.lit(0.0)) / 5) + 0.25 * volume)


def score_representatives(games: DataFrame) -> DataFrame:
    """Games with `representative_score`; segment maxima come as one map, so games stay where they are."""
    log_count = F.log1p(F.coalesce(to_number(F.col("rating_count")), F.lit(0.0)))
    scored = games.withColumn("__log", log_count)
    peaks = scored.groupBy("cluster_id").agg(F.max("__log").alias("__peak"))
    joined = scored.withColumn("__peak", per_segment(peaks, "cluster_id", F.col("__peak")))
    score = representative_score(to_number(F.col("chart_position")), to_number(F.col("average_rating")),
                                 F.col("__log"), F.col("__peak"))
    return joined.withColumn("representative_score", score).drop("__log", "__peak")


def representative_games(games: DataFrame, limit: int = 5,
                         tie: Sequence[str] = ("app_id", "chart_type")) -> DataFrame:
    """Titles of the best games of each segment, joined in score order.

    The score keeps 12 digits for ordering, so equal games tie and `tie` decides.
    """
    scored = score_representatives(games).withColumn(
        "__score", F.round("representative_score", 12))
    top = top_per_key(scored, ["cluster_id"], [F.desc("__score"), *tie], limit)
    return (top.groupBy("cluster_id")
            .agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("items"))
            .select("cluster_id", F.array_join("items.title", " | ").alias("representative_games")))


def developer_concentration(games: DataFrame) -> DataFrame:
    """Largest developer of each segment and its share; ties alphabetically first."""
    return segment_profile(games).select("cluster_id", "top_developer", "top_developer_share")


def with_concentration(summary: DataFrame, concentration: DataFrame, check: bool = False) -> DataFrame:
    """Summary with concentration, one row to one row."""
    return _one_to_one(summary, concentration, check)


def with_coherence(summary: DataFrame, coherence: DataFrame, check: bool = False) -> DataFrame:
    """Summary with coherence, one row to one row."""
    return _one_to_one(summary, coherence, check)


def _one_to_one(left: DataFrame, right: DataFrame, check: bool) -> DataFrame:
    if check:
        assert_unique(left, ["cluster_id"], "segment summary")
    return lookup_join(left, right, "cluster_id", check)


def _normalized(value: Column, low: Column, high: Column, higher_is_better: bool) -> Column:
    spread = (F.when(low.isNull() | high.isNull() | (low == high), F.lit(0.5))
              .otherwise((value - low) / F.nullif(high - low, F.lit(0.0))))
    unit = F.coalesce(spread, F.lit(0.5))
    return clip01(unit if higher_is_better else F.lit(1.0) - unit)


def min_max_normalize(df: DataFrame, columns: dict[str, tuple[Column, bool]],
                      per_segment: bool = False) -> DataFrame:
    """Add min-max normalised columns: name -> (value, higher is better).

    Null becomes 0.5 before the inversion, a constant column is 0.5 throughout.
    All bounds come from one aggregate, read as a one-row subquery. With
    `per_segment` the table holds one row per segment: the bounds then come from
    those few rows in one task, and what lies below is computed only once.
    """
    bounds = F.struct(*[stat(to_number(value)).alias(f"{name}_{kind}")
                        for name, (value, _) in columns.items()
                        for kind, stat in (("low", F.min), ("high", F.max))])
    if per_segment:
        everything = Window.partitionBy()
        bounds = F.struct(*[stat(to_number(value)).over(everything).alias(f"{name}_{kind}")
                            for name, (value, _) in columns.items()
                            for kind, stat in (("low", F.min), ("high", F.max))])
    else:
        bounds = df.agg(bounds.alias("bounds")).scalar()
    out = df.withColumn("__bounds", bounds).withColumns({
        name: _normalized(to_number(value), F.col(f"__bounds.{name}_low"),
                          F.col(f"__bounds.{name}_high"), better)
        for name, (value, better) in columns.items()})
    return out.drop("__bounds")


def score_components(df: DataFrame) -> DataFrame:
    """Add the six unweighted components in [0, 1] under their names."""
    log_ratings = F.log1p(F.coalesce(to_number(F.col("median_rating_count")), F.lit(0.0)))
    share = clip01(F.col("top_developer_share"))
    scaled = min_max_normalize(df, {
        "market_strength": (F.col("average_chart_position"), False),
        "__quality": (F.col("average_rating"), True),
        "__volume": (log_ratings, True),
        "__few_games": (F.col("game_count"), False),
        "__few_developers": (F.col("developer_count"), False),
        "__coherence": (F.col("semantic_coherence"), True),
    }, per_segment=True)
    return scaled.withColumns({
        "player_validation": 0.65 * F.col("__quality") + 0.35 * F.col("__volume"),
        "competition_gap": clip01((0.55 * F.col("__few_games") + 0.45 * F.col("__few_developers"))
                                  * (F.lit(1.0) - 0.80 * share)),
        "developer_diversity": clip01(F.lit(1.0) - F.col("top_developer_share")),
        "confidence": clip01(F.coalesce(to_number(F.col("game_count")), F.lit(0.0)) / 15),
    }).withColumnRenamed("__coherence", "coherence_component").drop(
        "__quality", "__volume", "__few_games", "__few_developers")


def confidence_level(games: Column, developers: Column, coherence: Column) -> Column:
    """High, Medium or Low from size, developers and coherence."""
    return (F.when((games >= 15) & (developers >= 8) & (coherence >= 0.25), "High")
            .when((games >= 7) & (developers >= 4) & (coherence >= 0.15), "Medium")
            .otherwise("Low"))


def segment_type(share: Column, coherence: Column, games: Column, gap_score: Column) -> Column:
    """Nature of a segment; the first rule that holds decides."""
    return (F.when(share >= 0.50, K.FRANCHISE_TYPE)
            .when(coherence < 0.15, K.MIXED_TYPE)
            .when((games >= 20) & (gap_score < 7), K.ESTABLISHED_TYPE)
            .otherwise(K.CANDIDATE_TYPE))


def warning_text(share: Column, coherence: Column, games: Column) -> Column:
    """Up to three warnings joined by `; `."""
    return F.concat_ws("; ", F.when(share >= 0.50, K.CONCENTRATION_WARNING),
                       F.when(coherence < 0.15, K.COHERENCE_WARNING),
                       F.when(games < 5, K.SIZE_WARNING))


def signal_summary() -> Column:
    """Sentence of the signals whose rounded score reaches its threshold."""
    joined = F.concat_ws("; ", *[F.when(F.col(name) >= least, text) for name, least, text in K.SIGNALS])
    return F.when(joined == "", K.NO_SIGNAL).otherwise(F.concat(capitalize(joined), F.lit(".")))


def ranking_penalty(kind: Column) -> Column:
    """15 for franchises, 20 for mixed segments, else 0."""
    return F.when(kind == K.FRANCHISE_TYPE, 15.0).when(kind == K.MIXED_TYPE, 20.0).otherwise(0.0)


def opportunity_scores(summary: DataFrame) -> DataFrame:
    """Score, label and rank segments.

    Needs the summary columns plus top_developer_share and semantic_coherence.
    The total adds unrounded components; labels read the rounded ones.
    """
    require_columns(summary, (*SUMMARY_COLUMNS, "top_developer_share", "semantic_coherence"),
                    "segment summary")
    unit = score_components(summary)
    source = {name: ("coherence_component" if name == "semantic_coherence" else name)
              for name in K.SCORE_WEIGHTS}
    raw = unit.withColumns({f"{name}_score": F.col(source[name]) * float(weight)
                            for name, weight in K.SCORE_WEIGHTS.items()}).drop(*set(source.values()) - {"semantic_coherence"})
    total = sum((F.col(c) for c in SCORE_COLUMNS[1:]), F.col(SCORE_COLUMNS[0]))
    rounded = (raw.withColumn("opportunity_score", round_even(total, 1))
               .withColumns({c: round_even(F.col(c), 1) for c in SCORE_COLUMNS})
               .withColumn("semantic_coherence", round_even(F.col("semantic_coherence"), 3)))
    share, coherence, games = F.col("top_developer_share"), F.col("semantic_coherence"), F.col("game_count")
    labelled = rounded.withColumns({
        "confidence_level": confidence_level(games, F.col("developer_count"), coherence),
        "segment_type": segment_type(share, coherence, games, F.col("competition_gap_score")),
        "warning": warning_text(share, coherence, games),
        "signal_summary": signal_summary(),
    }).withColumn("ranking_penalty", ranking_penalty(F.col("segment_type")))
    adjusted = labelled.withColumn("adjusted_opportunity_score", round_even(
        F.greatest(F.col("opportunity_score") - F.col("ranking_penalty"), F.lit(0.0)), 1))
    return rank_segments(adjusted)


def rank_segments(scores: DataFrame, column: str = "adjusted_opportunity_score") -> DataFrame:
    """Rank 1..n by score, ties by segment id.

    The table holds one row per segment, and the segment count is the k of the
    clustering (20 at most by default), so one task numbers it.
    """
    order = Window.orderBy(F.desc(column), "cluster_id")
    return scores.select(F.row_number().over(order).alias("opportunity_rank"), "*")


def score_breakdown(scores: DataFrame) -> DataFrame:
    """Six rows per segment: component, score, maximum, percent of the maximum."""
    long = scores.unpivot(["cluster_id"], list(SCORE_COLUMNS), "component", "score")
    maximum = F.lit(None).cast("int")
    for name, weight in K.SCORE_WEIGHTS.items():
        maximum = F.when(F.col("component") == f"{name}_score", F.lit(weight)).otherwise(maximum)
    return (long.withColumn("maximum", maximum)
            .withColumn("percent", 100 * F.col("score") / F.col("maximum")))
