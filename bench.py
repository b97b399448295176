"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8)
the local cores, BENCH_ONLY a comma-separated choice of queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segmentry import workload  # noqa: E402
from segmentry.session import build_session  # noqa: E402

HEADLINES = (
    "chart_feed_flatten", "lookup_flatten", "review_flatten", "review_page_cutoff", "first_per_chart",
    "metadata_join", "market_metrics", "developer_presence", "segment_summary", "representative_games",
    "developer_concentration", "opportunity_ranking", "score_breakdown", "description_clean", "review_clean",
    "tfidf_catalog", "segment_keywords", "segment_coherence", "text_opportunity_ranking", "review_dedupe",
    "negative_reviews", "segment_pain_points", "pain_point_evidence", "top_pain_points", "coverage_report",
    "rating_bands", "evidence_payload", "concept_extract", "cluster_silhouette_cosine", "nearest_items",
    "svd_reduce", "cluster_labels",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="16g", spark__sql__files__maxPartitionBytes="8MB",
                          spark__sql__files__openCostInBytes="1MB")
    spark.sparkContext.setLogLevel("ERROR")
    queries = workload.queries()
    # start the JVM, the reader and the code generator before timing
    queries["market_metrics"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in only or HEADLINES:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total wall-clock of headline queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
