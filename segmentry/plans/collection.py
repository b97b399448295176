"""From landed feeds to enriched charts and reviews, in stages that are not run again on unchanged input.

Every stage stores its tables below `root/<stage>/<fingerprint>`, where the fingerprint follows from the
files it reads, its parameters and the stages before it, and is noted in `root/runs` when all is written.
A run that finds the note reads what is stored; one that was cut off before it starts its stage anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.contracts import CHECKED, stored_checked
from segmentry.operators import reviews as R
from segmentry.session import together
from segmentry.sources import feeds, tables

RUNS = "stage string, fingerprint string"


@dataclass(frozen=True)
class Collection:
    """Chart rows, enriched games, reviews, coverage, documents that were no feeds, and the stages that ran."""

    charts: DataFrame
    enriched: DataFrame
    reviews: DataFrame
    coverage: DataFrame
    rejected: DataFrame
    ran: tuple[str, ...]


def fingerprint(spark: SparkSession, path: str, *more: object) -> str:
    """Digest of the names, sizes and times of all files under `path`, without reading them, and of `more`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    seen = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
    return hashlib.sha256(repr((*seen, *more)).encode()).hexdigest()[:32]


class Stages:
    """Stored results by stage and fingerprint."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.ran: list[str] = []

    def done(self, stage: str, mark: str) -> bool:
        try:
            runs = self.spark.read.schema(RUNS).parquet(f"{self.root}/runs")
        except AnalysisException:
            return False
        return not runs.filter((F.col("stage") == stage) & (F.col("fingerprint") == mark)).isEmpty()

    def run(self, stage: str, mark: str, build: Callable[[], dict[str, DataFrame]], least: dict[str, str] | None = None) -> dict[str, DataFrame]:
        """Tables of a stage, built only if they are not stored; `least` names tables that must not be empty."""
        folder = f"{self.root}/{stage}/{mark}"
        if not self.done(stage, mark):
            built = build()

            def store(name: str) -> None:
                guards = {what: CHECKED for table, what in (least or {}).items() if table == name}
                stored_checked(built[name], f"{folder}/{name}", guards)

            together(self.spark, *(partial(store, name) for name in built))
            self.spark.createDataFrame([(name,) for name in built], "name string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/tables")
            note = self.spark.createDataFrame([(stage, mark)], RUNS)
            note.coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
            self.ran.append(stage)
        names = [r["name"] for r in self.spark.read.parquet(f"{folder}/tables").collect()]
        return {name: self.spark.read.parquet(f"{folder}/{name}") for name in names}


def collect_charts(docs: DataFrame) -> dict[str, DataFrame]:
    """Chart rows, and per chart how many documents were no feed; a bad document spoils no other."""
    bad = docs.filter(~feeds.is_chart_feed(F.col("doc"))).groupBy("chart_type").agg(F.count(F.lit(1)).alias("documents"))
    return {"charts": feeds.chart_entries(docs), "rejected": bad}


def enrich_charts(charts: DataFrame, lookups: DataFrame) -> dict[str, DataFrame]:
    """Chart rows with cleaned ids joined to one metadata record per app."""
    games = charts.withColumn("app_id", F.btrim("app_id")).filter(F.col("app_id") != "")
    records = tables.unique_metadata(feeds.lookup_records(lookups).filter(F.col("app_id") != ""))
    return {"enriched": tables.enrich(games, records, check=False)}


def collect_reviews(enriched: DataFrame, pages: DataFrame, max_pages: int, full_page: int, max_reviews: int | None) -> dict[str, DataFrame]:
    """Valid reviews, each once, of the pages a stopping reader would have read, and the coverage of all games."""
    cut = feeds.page_cutoff(feeds.page_facts(pages), max_pages, full_page, max_reviews)
    kept = cut.filter("kept").select("app_id", "page_number")
    rows = feeds.cap_reviews(feeds.review_rows(pages.join(kept, ["app_id", "page_number"])), max_reviews)
    reviews = R.dedupe_reviews(R.valid_reviews(rows), ["page_number", "entry_position"])
    games = enriched.groupBy("app_id").agg(F.min("title").alias("game_title"), F.min("developer").alias("developer"))
    coverage = R.coverage_report(games, reviews, feeds.collection_coverage(cut, max_reviews))
    return {"reviews": reviews, "coverage": coverage}


def run_collection(spark: SparkSession, root: str, chart_docs: str, lookup_docs: str, review_pages: str, max_pages: int = 5,
                   full_page: int = 40, max_reviews: int | None = None) -> Collection:
    """Collect, enrich, reviews from landed Parquet folders; stages with unchanged input are read, not run.

    No chart rows at all is an error, as is a run without any enriched game.
    """
    stages = Stages(spark, root)
    read = spark.read.parquet
    mark = fingerprint(spark, chart_docs)
    charts = stages.run("collect", mark, lambda: collect_charts(read(chart_docs)), {"charts": "chart rows"})
    mark = fingerprint(spark, lookup_docs, mark)
    enriched = stages.run("enrich", mark, lambda: enrich_charts(charts["charts"], read(lookup_docs)), {"enriched": "enriched games"})["enriched"]
    mark = fingerprint(spark, review_pages, mark, max_pages, full_page, max_reviews)
    found = stages.run("reviews", mark, lambda: collect_reviews(enriched, read(review_pages), max_pages, full_page, max_reviews))
    return Collection(charts["charts"], enriched, found["reviews"], found["coverage"], charts["rejected"], tuple(stages.ran))
