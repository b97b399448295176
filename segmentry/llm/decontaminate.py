"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.common import PUNCTUATED, bound_batches, chunks, shingles, table
from segmentry.session import materialize

#: Words of a shingle, and the share of an item's shingles that a document must hold (percent).
SHINGLE, PERCENT = 5, 80
#: Chance to miss an item that a document just holds.
MISS = 1e-7
#: Bytes of item text that one pass over the documents takes as its query set.
BLOCK_BYTES = 8_000_000


def bin_load(shared: int, miss: float = MISS) -> float:
    """Largest number of document shingles a MinHash bin may get; 0 if all must be kept.

    A shared shingle is the minimum of its bin with chance (1 - exp(-load)) / load. An item is missed
    if none of its `shared` shingles is.
    """
    need = 1 - miss ** (1 / shared)
    if need > 0.95:
        return 0.0
    low, high = 1e-3, 1e6
    for _ in range(60):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if -np.expm1(-mid) / mid >= need else (low, mid)
    return low


class Index:
    """A block of items: their shingles, and per size class and bin count their bin minima."""

    def __init__(self, ids: list, texts: pa.Array):
        self.ids, self.sets = ids, []
        for _, data, offsets in chunks(texts):
            self.sets += shingles(data, offsets, SHINGLE, PUNCTUATED)
        self.need = np.array([-(-PERCENT * len(s) // 100) for s in self.sets])
        # items of one class need about the same number of shared shingles
        level = [int(n).bit_length() for n in self.need]
        self.classes = {k: [i for i, x in enumerate(level) if x == k] for k in sorted(set(level)) if k}
        self.load = {k: bin_load(1 << (k - 1)) for k in self.classes}
        self._minima: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def minima(self, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted bin minima of the items of a class with 2**bits bins, and whose they are."""
        if (level, bits) not in self._minima:
            values, owners = [], []
            for i in self.classes[level]:
                kept = self.sets[i][first_of_bin(self.sets[i], bits)]
                values.append(kept)
                owners.append(np.full(len(kept), i))
            values, owners = np.concatenate(values), np.concatenate(owners)
            order = np.argsort(values, kind="stable")
            self._minima[level, bits] = values[order], owners[order]
        return self._minima[level, bits]


def first_of_bin(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Mask of the minimum of each of 2**bits bins of sorted hashes; bins are top bits."""
    if bits >= 63 or not len(hashes):
        return np.ones(len(hashes), bool)
    bins = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
    return np.r_[True, bins[1:] != bins[:-1]]


def search(index: Index, sets: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(document, item, shingles held) of every document that holds an item."""
    for level, load in index.load.items():
        by_bits: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            if len(s):
                by_bits.setdefault(max(0, int(np.ceil(np.log2(len(s) / load)))) if load else 63, []).append(i)
        for bits, members in by_bits.items():
            values, owners = index.minima(level, bits)
            kept = [sets[i][first_of_bin(sets[i], bits)] for i in members]
            flat = np.concatenate(kept)
            of = np.repeat(members, [len(k) for k in kept])
            low, high = np.searchsorted(values, flat, "left"), np.searchsorted(values, flat, "right")
            hit = np.flatnonzero(high > low)
            width = (high - low)[hit]
            at = np.repeat(low[hit], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            pairs = np.unique(np.stack([np.repeat(of[hit], width), owners[at]], 1), axis=0) if len(hit) else []
            for d, i in pairs:
                have, item = sets[d], index.sets[i]
                place = np.minimum(np.searchsorted(have, item), len(have) - 1)
                held = int((have[place] == item).sum())
                if held >= index.need[i]:
                    yield int(d), int(i), held


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, held, size: documents that hold at least PERCENT of an item's shingles.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item without words
    is held by nothing; one with fewer than SHINGLE words only by a document of just these words.
    Null texts hold nothing; repeated rows of documents give repeated rows, repeated items count once.

    The items are the stated query set: they pass the documents in blocks of BLOCK_BYTES of text, each
    block read by all tasks; any number of items is searched, one scan of the documents per block.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    queries = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter(
        F.length("text") > 0).distinct()
    total = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    queries = materialize(queries.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    found = None
    for block in range(blocks):
        rows = queries.filter(F.col("block") == block).toArrow()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast((rows.column("item_id").to_pylist(), rows.column("text").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(*shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                out = []
                for first, data, offsets in chunks(batch.column(1)):
                    for d, i, held in search(index, shingles(data, offsets, SHINGLE, PUNCTUATED)):
                        out.append((ids[first + d], index.ids[i], held, len(index.sets[i])))
                columns = list(zip(*out)) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=["doc_id", "item_id", "held", "size"])

        part = given.mapInArrow(run, "doc_id long, item_id long, held long, size long")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without the documents that hold an item. Rows with a null doc_id stay.

    The ids found are stored first: Spark broadcasts them only if their files are small.
    """
    found = materialize(contained(docs, items).select(F.col("doc_id").alias("__found")).distinct(), "contaminated")
    return docs.join(found, F.col("doc_id") == F.col("__found"), "left_anti")


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every (document, benchmark item) where the document holds the item."""
    return contained(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_WORDS = (r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')")
_SHINGLES = """SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM {}"""
OP10_SQL = f"""
WITH dw AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark),
ds AS ({_SHINGLES.format("dw")}), its AS ({_SHINGLES.format("iw")}),
sizes AS (SELECT id, count(*) AS size FROM its GROUP BY id)
SELECT ds.id AS doc_id, its.id AS item_id, count(*) AS held, any_value(size) AS size
FROM ds JOIN its USING (s) JOIN sizes ON sizes.id = its.id
GROUP BY ds.id, its.id HAVING 100 * count(*) >= 80 * any_value(size)"""
