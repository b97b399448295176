"""Corpus pipeline: language, near copies, benchmark passages, secrets, tokens.

Every stage takes (spark, docs, folder) and works on all that the stage before kept; all but the last
return the columns of documents. The language stage drops documents without a language, the join keeps
the smallest doc_id of each group of near copies (five-word shingles, 80 percent), decontamination
drops documents that hold a benchmark item, the scan masks live secrets, the last stage tokenises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm import bpe, decontaminate, jaccard, language, secrets
from segmentry.llm.common import table
from segmentry.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is known with confidence."""
    return language.keep_identified(docs, suffix=language.country_end())


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, live secrets masked; n_chars follows the text."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.when(F.contains("text", F.lit(secrets.MARK)), F.length("text").cast("long"))
                             .otherwise(F.col("n_chars"))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and the text decoded from them."""
    path = bpe.default_vocabulary()
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), path).drop("text")
    return bpe.decode(encoded, path).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scans", mask_secrets),
    ("bpe", tokenize),
]

#: The stages cannot be stated in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over documents, each stored and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
