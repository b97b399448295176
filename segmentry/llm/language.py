"""Language ID by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.common import bound_batches, chunks, table
from segmentry.session import materialize

#: Labelled texts per language that the text model is fitted on, about, and texts that make a language known.
SAMPLE_TEXTS, LEAST_TEXTS = 1_000, 2
#: Languages that texts are scored for at once.
BLOCK = 64
#: Slots that byte trigrams hash into.
SLOTS = 1 << 14
#: Trigrams that count as independent evidence: longer texts weigh no more.
EVIDENCE = 60
#: Weight of the parent's shares in a domain's and in a host's.
DOMAIN_WEIGHT, HOST_WEIGHT = 20.0, 10.0
#: Least posterior of a kept document.
CONFIDENCE = 0.5


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of byte trigrams of each row of a chunk; ASCII letters lower-cased, other ASCII a blank.

    Trigrams with more than one blank are left out.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = np.full(256, 32, np.uint8)
    plain[128:] = np.arange(128, 256)
    for a in (65, 97):
        plain[a:a + 26] = np.arange(97, 123)
    seen = plain[data]
    blank = (seen == 32).astype(np.int8)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    good = (row[2:] == row[:-2]) & (blank[:-2] + blank[1:-1] + blank[2:] < 2)
    at = np.flatnonzero(good)
    wide = seen.astype(np.uint32)
    slot = (wide[at] * np.uint32(0x01000193) + wide[at + 1] * np.uint32(0x85EBCA6B) + wide[at + 2] * np.uint32(0xC2B2AE35))
    return row[at], (slot ^ (slot >> np.uint32(15))).astype(np.int64) % SLOTS


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log shares of slots) from declared languages of a bounded sample of whole texts.

    Every language that LEAST_TEXTS texts or more declare is known. Of each, about SAMPLE_TEXTS texts are taken:
    those whose hash is below a bound that follows from the language's count, so nothing is shuffled but
    counts per (language, slot), of which languages x SLOTS come back.
    """
    known = rows.filter("declared is not null and length(text) > 0")
    often = known.groupBy("declared").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    often = materialize(often, "languages")
    names = sorted(often.select("declared").toArrow()["declared"].to_pylist())
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) * F.col("n") < (1 << 30) * SAMPLE_TEXTS
    picked = known.join(often, "declared").filter(drawn).select("declared", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            declared = batch.column(0).to_pylist()
            for first, data, offsets in chunks(batch.column(1)):
                row, slot = trigrams(data, offsets)
                ends = np.searchsorted(row, np.arange(len(offsets)))
                for i, name in enumerate(declared[first:first + len(offsets) - 1]):
                    total[name] = total.get(name, 0) + np.bincount(slot[ends[i]:ends[i + 1]], minlength=SLOTS)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(counts[at].astype(np.int64))], names=["declared", "slot", "n"])

    counts = picked.mapInArrow(run, "declared string, slot int, n long").groupBy("declared", "slot").agg(F.sum("n").alias("n"))
    counts = counts.toArrow()
    share = np.full((len(names), SLOTS), 0.5)
    if counts.num_rows:
        place = {name: i for i, name in enumerate(names)}
        share[[place[d] for d in counts["declared"].to_pylist()], counts["slot"].to_numpy()] += counts["n"].to_numpy()
    return names, np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)


def _scored(rows: DataFrame, names: list[str], weights: np.ndarray) -> DataFrame:
    """doc_id, declared, suffix, host, scores (tempered log likelihood per language), seen (trigrams)."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # languages x SLOTS values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [np.ascontiguousarray(shared.value[at:at + BLOCK].T) for at in range(0, len(names), BLOCK)]
        for batch in batches:
            scores, seen = np.zeros((len(batch), len(names))), np.zeros(len(batch), np.int64)
            for first, data, offsets in chunks(batch.column("text")):
                row, slot = trigrams(data, offsets)
                if len(row):
                    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    for k, part in enumerate(blocks):
                        scores[first + row[starts], k * BLOCK:k * BLOCK + part.shape[1]] = np.add.reduceat(
                            part[slot], starts, axis=0, dtype=np.float64)
                    seen[first:first + len(offsets) - 1] = np.bincount(row, minlength=len(offsets) - 1)
            scores *= (np.minimum(seen, EVIDENCE) / np.maximum(seen, 1))[:, None]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(n) for n in ("doc_id", "declared", "suffix", "host")),
                pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(names), pa.int32()), pa.array(scores.ravel())),
                pa.array(seen)], names=["doc_id", "declared", "suffix", "host", "scores", "seen"])

    return rows.mapInArrow(run, "doc_id long, declared string, suffix string, host string, scores array<double>, seen long")


def _values(numbers: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in numbers))


def _reliability(scored: DataFrame, column: str, names: list[str]) -> tuple[Column, DataFrame]:
    """What a row states (null: nothing), and log likelihoods of that per true language, from their table of counts.

    The text's best language stands for the true one. States that name no known language are one more.
    """
    place = {name: i for i, name in enumerate([*names, ""])}
    stated = F.when(F.col(column).isNull(), None).when(F.col(column).isin(names), F.col(column)).otherwise("")
    counts = scored.filter("seen > 0").groupBy(stated.alias("stated"), "best").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter("stated is not null").toArrow()  # at most (languages + 1) x languages rows
    seen = np.full((len(place), len(names)), 0.1)
    if counts.num_rows:
        seen[[place[x] for x in counts["stated"].to_pylist()], counts["best"].to_numpy()] += counts["n"].to_numpy()
    likelihood = np.log(seen / seen.sum(axis=0))
    table = pa.table({f"__{column}": pa.array(list(place)), f"__by_{column}": pa.array(likelihood.tolist(), pa.list_(pa.float64()))})
    return stated, materialize(scored.sparkSession.createDataFrame(table), "stated")


def identify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", declared: str | Column | None = "lang",
             suffix: str | Column | None = None, host: str | Column | None = "source",
             accepted: Sequence[str] | None = None) -> DataFrame:
    """doc_id, language, confidence, declared, kept of every row.

    Posterior = text likelihood x likelihood of the declared language x likelihood of the address suffix
    x host prior. A host's prior is its texts' languages smoothed by its domain's, those by all
    texts'; the row itself is taken out of its host's counts. Rows without a trigram of letters (null, empty, digits only)
    get no language and are not kept; others are kept at CONFIDENCE, if `accepted` names their language
    or is None. Null declared, suffix or host give no evidence. Repeated rows stay rows of their own.
    Without any declared language there are no languages and nothing is kept; a language that fewer than
    LEAST_TEXTS texts declare is not known, and its texts get the likeliest known one.

    Texts are read twice (fit, score) and never shuffled; priors are grouped counts that combine
    map-side, joined to rows without texts.
    """
    bound_batches(docs.sparkSession)
    col = lambda c: F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).alias("text"), F.lower(F.substring_index(col(declared).cast("string"), "-", 1)).alias("declared"),
                       F.lower(col(suffix).cast("string")).alias("suffix"), F.lower(col(host).cast("string")).alias("host"))
    names, weights = fit(rows)
    if not names:
        return rows.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"),
                           "declared", F.lit(False).alias("kept"))
    best = F.when(F.col("seen") > 0, F.array_position("scores", F.array_max("scores")).cast("int") - 1)
    scored = materialize(_scored(rows, names, weights).withColumn("best", best), "scored")

    size = len(names)
    tally = [F.count(F.when(F.col("best") == i, 1)).cast("double") for i in range(size)]
    hosts = scored.filter("best is not null and host is not null").groupBy("host").agg(F.array(*tally).alias("own"))
    domain = F.substring_index("host", ".", -2)
    per_domain = hosts.groupBy(domain.alias("domain")).agg(
        F.array(*(F.sum(F.col("own")[i]) for i in range(size))).alias("of_domain"))
    overall = scored.agg(F.array(*tally)).first()[0]
    overall = [(n + 1) / (sum(overall) + size) for n in overall]

    share = lambda counts, parent, weight: F.zip_with(
        counts, parent, lambda n, p: (n + weight * p) / (F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) + weight))
    priors = materialize(
        hosts.withColumn("domain", domain).join(per_domain, "domain")
        .withColumn("of_domain", share(F.col("of_domain"), _values(overall), DOMAIN_WEIGHT))
        .select("host", "own", "of_domain"), "hosts")
    less = F.transform("own", lambda n, i: n - F.when(i == F.col("best"), 1.0).otherwise(0.0))
    prior = F.when(F.col("own").isNull(), _values(overall)).otherwise(share(less, F.col("of_domain"), HOST_WEIGHT))

    joined, parts = scored.join(priors, "host", "left"), [F.transform(prior, lambda p: F.log(p))]
    for column in ("declared", "suffix"):
        stated, table_ = _reliability(scored, column, names)
        joined = joined.join(table_, stated == F.col(f"__{column}"), "left")
        parts.append(F.coalesce(F.col(f"__by_{column}"), F.array_repeat(F.lit(0.0), size)))
    logs = F.transform("scores", lambda x, i: sum((p[i] for p in parts), x))
    top = F.array_max("logs")
    found = (joined.withColumn("logs", logs)
             .withColumn("place", F.array_position("logs", top).cast("int"))
             .withColumn("confidence", 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - top))))
    language = F.when(F.col("seen") > 0, F.element_at(F.array(*(F.lit(n) for n in names)), F.col("place")))
    found = found.select("doc_id", language.alias("language"),
                         F.when(F.col("seen") > 0, F.col("confidence")).otherwise(0.0).alias("confidence"), "declared")
    wanted = F.lit(True) if accepted is None else F.col("language").isin(list(accepted))
    return found.withColumn("kept", F.coalesce(F.col("language").isNotNull() & (F.col("confidence") >= CONFIDENCE) & wanted,
                                               F.lit(False)))


def keep_identified(docs: DataFrame, **evidence) -> DataFrame:
    """`docs` without rejected documents. Rows without doc_id stay; a doc_id goes only if all its rows are rejected.

    The ids to go are stored first: Spark broadcasts them only if their files are small.
    """
    found = identify(docs, **evidence)
    gone = materialize(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept and doc_id is not null")
                       .select(F.col("doc_id").alias("__gone")), "rejected")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, suffix, host of web pages: markup language, language part or country end of the address."""
    host = F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1)
    path = F.regexp_extract("url", r"^[a-zA-Z]+://[^/]+/([a-z]{2})(?:[/?#-]|$)", 1)
    end = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    markup = F.regexp_extract("html", r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-z]+)""", 1)
    empty = lambda c: F.when(c != "", c)
    plain = F.regexp_replace("html", r"(?is)<(script|style|head)\b.*?</\1\s*>|<[^>]*>|&[a-zA-Z#0-9]+;", " ")
    return pages.select("page_id", plain.alias("text"), empty(markup).alias("declared"),
                        F.coalesce(empty(path), empty(end)).alias("suffix"), empty(host).alias("host"))


def country_end(source: str = "source") -> Column:
    """Country ending of a source's address, null without one: the suffix evidence of documents."""
    end = F.regexp_extract(source, r"\.([a-z]{2})$", 1)
    return F.when(end != "", end)


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: the table's lang is the declared language, its source the host."""
    return identify(table(spark, folder, "documents"), suffix=country_end())


def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages by markup language, address and host."""
    found = identify(page_evidence(table(spark, folder, "pages")), doc_id="page_id", declared="declared", suffix="suffix", host="host")
    return found.withColumnRenamed("doc_id", "page_id")
