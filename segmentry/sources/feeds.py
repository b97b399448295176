"""Landed JSON documents as typed tables: charts, lookups, review pages.

Each document is parsed by the JSON functions of Spark with a declared schema, so
nothing is inferred and unread fields are never built. The functions hold no state
and work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmentry import schemas
from segmentry.functions.columns import text_number, to_timestamp_utc
from segmentry.operators.rows import first_per_key


# documents whose first field is `feed` and whose first field is `entry`: what the entry begins with shows without parsing
_BEGINS = r'^\s*\{\s*"feed"\s*:\s*\{\s*"entry"\s*:\s*'


def _is_json(text: Column, *openers: str) -> Column:
    return F.substring(F.trim(text), 1, 1).isin(*openers)


def _entries(doc: Column, element: str) -> Column:
    """`feed.entry` as an array of `element`: a list, or one object as a list of one.

    A list that mixes objects with other values is read item by item and keeps its
    objects. The cheap case comes first; the others run only where it fails, since a parse that
    fails costs more than one that fits.
    """
    def parse(kind: str) -> Column:
        return F.from_json(doc, f"feed struct<entry:{kind}>")["feed"]["entry"]

    objects = F.transform(F.filter(parse("array<string>"), lambda e: _is_json(e, "{")),
                          lambda e: F.from_json(F.concat(F.lit('{"e":'), e, F.lit("}")), f"e {element}")["e"])
    single = F.array_compact(F.array(parse(element)))
    found = F.coalesce(parse(f"array<{element}>"), objects, single)
    lone = F.when(F.size(single) > 0, single)
    return F.when(doc.rlike(_BEGINS + r"\{"), F.coalesce(lone, found)).otherwise(found)


def is_chart_feed(doc: Column) -> Column:
    """Whether a document's entries are absent, a list or one object; other documents are no chart feeds."""
    raw = F.get_json_object(doc, "$.feed.entry")
    told = doc.rlike(_BEGINS + r"[\[{]")
    return F.when(told, F.lit(True)).otherwise(F.coalesce(raw.isNull() | _is_json(raw, "[", "{"), F.lit(True)))


def chart_entries(docs: DataFrame, strict: bool = False, country: str = "US") -> DataFrame:
    """Chart documents (doc, chart_type, source_url, snapshot_date) as one row per app.

    A single object counts as a list of one; positions start at 1. An entry that is
    neither is skipped with its document, or raises when `strict`.
    """
    doc = F.col("doc")
    if strict:
        message = F.concat(F.lit("unexpected feed format for chart "), F.col("chart_type"))
        doc = F.when(is_chart_feed(doc), doc).otherwise(F.raise_error(message))
    rows = docs.select("chart_type", "source_url", "snapshot_date",
                       F.posexplode(_entries(doc, schemas.CHART_ENTRY)).alias("pos", "e"))
    genre = F.col("e.category.attributes.label")
    images = F.col("e.`im:image`")
    return rows.select(
        F.col("e.id.attributes.`im:id`").alias("app_id"),
        F.col("e.`im:name`.label").alias("title"),
        F.col("e.`im:artist`.label").alias("developer"),
        F.col("e.`im:releaseDate`.attributes.label").alias("release_date"),
        genre.alias("primary_genre"), genre.alias("genres"),
        F.get(images, F.size(images) - 1)["label"].alias("artwork_url"),
        F.col("e.id.label").alias("app_store_url"), "chart_type",
        (F.col("pos") + 1).alias("chart_position"), F.lit(country).alias("country"),
        F.col("snapshot_date").cast("string").alias("snapshot_date"), "source_url")


def append_charts(charts: Sequence[DataFrame], check: bool = False) -> DataFrame:
    """Rows of all charts; with `check`, no rows at all is an error."""
    if not charts:
        raise ValueError("no chart data was collected")
    out = reduce(DataFrame.unionByName, charts)
    if check and out.isEmpty():
        raise ValueError("no chart data was collected")
    return out


def lookup_records(docs: DataFrame) -> DataFrame:
    """Lookup documents (doc = one record) as the 26 metadata columns, all rows kept."""
    r = docs.select(F.from_json("doc", schemas.LOOKUP_RECORD).alias("r"))
    
    def field(name: str) -> Column:
        return F.col(f"r.{name}")

    genres = F.when(_is_json(field("genres"), "["), F.from_json(field("genres"), "array<string>"))
    features = F.trim(F.coalesce(field("features"), F.lit("")))
    columns = {"app_id": F.coalesce(field("trackId"), F.lit(""))}
    columns |= {out: field(src) for out, src in schemas.LOOKUP_TEXT.items()}
    columns |= {"detailed_genres": F.coalesce(F.array_join(genres, " | "), F.lit(""))}
    columns |= {out: text_number(field(src)) for out, src in schemas.LOOKUP_NUMBERS.items()}
    columns |= {out: to_timestamp_utc(field(src)) for out, src in schemas.LOOKUP_TIMES.items()}
    columns |= {out: F.coalesce(F.array_join(field(src), " | "), F.lit(""))
                for out, src in schemas.LOOKUP_LISTS.items()}
    columns |= {"has_in_app_purchases": ~features.isin("", "[]", "{}", "0", "0.0", "false")}
    order = [part.split()[0] for part in schemas.METADATA.split(", ")]
    return r.select(*[columns[name].alias(name) for name in order])


def lookup_results(docs: DataFrame) -> DataFrame:
    """Lookup responses (doc = `{"results": [..]}`) as one document per record."""
    raw = F.from_json("doc", "results array<string>")["results"]
    return docs.select(F.explode(raw).alias("doc"))


def label_of(object_text: Column) -> Column:
    """Value of `{"label": value}` as text; null for anything that is no such object."""
    return F.when(_is_json(object_text, "{"), F.get_json_object(object_text, "$.label"))


def review_page_entries(pages: DataFrame) -> DataFrame:
    """Pages with `entries`: the review entries of `doc`, each a map of raw fields.

    An entry counts when it is an object with both a rating and a content field.
    """
    entries = F.filter(_entries(F.col("doc"), "map<string,string>"), lambda e: (
        e.isNotNull() & F.map_contains_key(e, "im:rating") & F.map_contains_key(e, "content")))
    return pages.withColumn("entries", entries)


def review_rows(pages: DataFrame, keep: Sequence[str] = ("page_number",),
                country: str = "US") -> DataFrame:
    """Review pages (app_id, game_title, developer, doc, ..) as typed review rows.

    `entry_position` is the 0-based place on the page. Ratings are cut to whole
    numbers; rows without rating or text, or outside 1..5, are dropped.
    """
    rows = pages.select("app_id", "game_title", "developer", *keep, F.posexplode(
        _entries(F.col("doc"), schemas.REVIEW_ENTRY)).alias("entry_position", "e"))
    number = text_number(F.col("e.`im:rating`.label"))
    # truncation towards zero, so 0.9 is out and 5.9 is in
    whole = F.when(F.abs(number) < 1e9, number.cast("int"))
    out = rows.select(
        "app_id", "game_title", "developer", *keep, "entry_position",
        F.col("e.id.label").alias("review_id"), F.col("e.author.name.label").alias("reviewer"),
        F.col("e.title.label").alias("review_title"), F.col("e.content.label").alias("review_text"),
        whole.alias("review_rating"), F.col("e.updated.label").alias("review_date"),
        F.col("e.`im:version`.label").alias("review_version"), F.lit(country).alias("country"))
    return out.filter(F.col("review_text").isNotNull() & F.col("review_rating").between(1, 5))


def cap_reviews(reviews: DataFrame, max_reviews: int | None,
                order: Sequence[str | Column] = ("page_number", "entry_position")) -> DataFrame:
    """First `max_reviews` reviews of each app in feed order; None keeps all."""
    if max_reviews is None:
        return reviews
    window = Window.partitionBy("app_id").orderBy(*order)
    return (reviews.withColumn("__n", F.row_number().over(window))
            .filter(F.col("__n") <= max_reviews).drop("__n"))


def page_facts(pages: DataFrame) -> DataFrame:
    """Per page: entries found, reviews that parse, and whether the request failed.

    Works inside the row: entries are tested where they are, no rows are exploded.
    """
    def parses(entry: Column) -> Column:
        number = text_number(label_of(entry["im:rating"]))
        text = label_of(entry["content"])
        return F.coalesce((number >= 1) & (number < 6) & text.isNotNull(), F.lit(False))

    listed = review_page_entries(pages)
    return listed.select(
        "app_id", "page_number", F.json_object_keys("doc").isNull().alias("failed"),
        F.size("entries").alias("entry_count"),
        F.size(F.filter("entries", parses)).alias("parsed_count"))


def page_cutoff(facts: DataFrame, max_pages: int = 5, full_page: int = 40,
                max_reviews: int | None = None, count_capped_page: bool = False) -> DataFrame:
    """Pages that a reader stopping at the first terminal page would have read.

    A page is terminal when its request failed, it is empty, the cap is met on it or
    it holds fewer than `full_page` reviews. A missing page counts as a failed
    request. Adds `kept` (its reviews are used), `counted` (it is part of
    pages_collected; a page that meets the cap is not, unless `count_capped_page`)
    and `stop_reason`. At most `max_pages` rows of an app take part.
    """
    single = first_per_key(facts.filter(F.col("page_number").between(1, max_pages)),
                           ["app_id", "page_number"], [F.desc("parsed_count"), "failed"])
    window = Window.partitionBy("app_id").orderBy("page_number")
    running = window.rowsBetween(Window.unboundedPreceding, 0)
    read = F.when(~F.col("failed") & (F.col("entry_count") > 0), F.col("parsed_count")).otherwise(0)
    out = (single.withColumn("__gap", F.row_number().over(window) != F.col("page_number"))
           .withColumn("reviews_so_far", F.sum(read).over(running)))
    capped = F.lit(False) if max_reviews is None else F.col("reviews_so_far") >= max_reviews
    reason = (F.when(F.col("failed") | F.col("__gap"), "failed")
              .when(F.col("entry_count") == 0, "empty").when(capped, "capped")
              .when(F.col("parsed_count") < full_page, "short"))
    out = out.withColumn("stop_reason", reason)
    stopped = F.count("stop_reason").over(window.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("__stopped", stopped).filter(F.col("__stopped") == 0)
    used = F.col("stop_reason").isNull() | F.col("stop_reason").isin("capped", "short")
    counted = used if count_capped_page else used & ~F.col("stop_reason").eqNullSafe("capped")
    return (out.withColumn("kept", used).withColumn("counted", counted)
            .drop("__gap", "__stopped"))


def collection_coverage(cutoff: DataFrame, max_reviews: int | None = None) -> DataFrame:
    """Per app from the page cut-off: reviews_collected, pages_collected, request_failed."""
    total = F.sum(F.when(F.col("kept"), F.col("parsed_count")).otherwise(0))
    if max_reviews is not None:
        total = F.least(total, F.lit(max_reviews))
    return cutoff.groupBy("app_id").agg(
        total.alias("reviews_collected"), F.count_if("counted").alias("pages_collected"),
        F.coalesce(F.bool_or(F.col("stop_reason") == "failed"), F.lit(False)).alias("request_failed"))


def collected_reviews(pages: DataFrame, max_pages: int = 5, full_page: int = 40,
                      max_reviews: int | None = None) -> DataFrame:
    """Reviews of the pages a stopping reader would have read, capped per app."""
    cut = page_cutoff(page_facts(pages), max_pages, full_page, max_reviews)
    kept = cut.filter("kept").select("app_id", "page_number")
    return cap_reviews(review_rows(pages.join(kept, ["app_id", "page_number"])), max_reviews)
