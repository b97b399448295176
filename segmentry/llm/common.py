"""Shared helpers: tables, bounded Arrow batches, range hashes, shingles, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.session import materialize

#: Bytes of text that a worker takes on at once, besides a single longer text.
CHUNK_BYTES = 500_000
#: Bytes of those that numpy works on at once: 64-bit values of so many stay in a core's cache and leave little memory behind.
PIECE_BYTES = 100_000
#: Powers that a worker keeps; longer texts compute their own.
KEPT_POWERS = 1 << 19
#: Rows of one Arrow batch sent to a Python worker.
BATCH_ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; Python workers get small batches from here on."""
    bound_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: documents may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * CHUNK_BYTES))
    # a text is shuffled only if a Bloom filter of the other side's keys, where that side is small, may hold its key
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- texts as flat byte buffers -------------------------------------------------------------

def chunks(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows up to `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    texts = texts.cast(pa.large_binary())
    rows = len(texts)
    if not rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + rows + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), wrapping at 64 bits; grown on demand and kept per worker up to a bound."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length()) if n <= KEPT_POWERS else n
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= KEPT_POWERS:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (a, b), sorted."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


class RangeHash:
    """64-bit hash of any byte range of one buffer from prefix sums, equal for equal bytes."""

    def __init__(self, data: np.ndarray):
        self._prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, len(data)), dtype=np.uint64, out=self._prefix[1:])
        self._undo = _power(_INVERSE, len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self._prefix[ends] - self._prefix[starts]) * self._undo[starts]
        return mix(value ^ (np.asarray(ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _byte_table(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.ones(256, bool)
    word[list(separators)] = False
    return lower, word


#: White space of the plain word rule, and the same with ASCII punctuation.
SPACE = b" \t\n\x0b\x0c\r"
PUNCTUATED = bytes(i for i in range(128) if not chr(i).isalnum())


def words(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of a chunk, A-Z lower-cased; words never cross rows."""
    lower, is_word = _byte_table(separators)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = is_word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, RangeHash(lower[data])(starts, ends)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int, separators: bytes = SPACE) -> list[np.ndarray]:
    """Sorted distinct hashes of `size`-word shingles of each row of a chunk.

    A row with fewer words has its whole sequence as the only shingle; one without words has none.
    """
    rows, hashes = words(data, offsets, separators)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    starts = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros(len(hashes), np.uint64)
    taken = np.minimum(size, np.repeat(starts[1:], counts) - np.arange(len(hashes)))
    for j in range(size):
        have = np.flatnonzero(taken > j)
        total[have] += hashes[have + j] * _PLACE[j]
    whole = taken == size
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole[starts[short]] = True
    total = mix(total + taken.astype(np.uint64) * _PLACE[15])
    return [np.unique(total[a:b][whole[a:b]]) for a, b in zip(starts[:-1], starts[1:])]


# --- connected components -------------------------------------------------------------------

def components(edges: DataFrame, left: str, right: str, node: str = "node", component: str = "component") -> DataFrame:
    """Smallest node reachable from every node that has an edge to another.

    Each round points every node at its smallest neighbour, doubles the pointers once, and
    replaces the edges by edges between the nodes pointed at, so rounds grow with the logarithm
    of the longest chain. Edges and pointers of a round are written to the shared folder. Minima
    combine map-side, so a node with very many edges costs one row per task.
    """
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    rest = materialize(edges.select(*pair(F.col(left), F.col(right))).filter("u <> v").distinct(), "edges")
    labels = materialize(rest.select(F.col("u").alias(node)).union(rest.select(F.col("v").alias(node))).distinct()
                         .withColumn(component, F.col(node)), "labels")
    while not rest.isEmpty():
        near = materialize(rest.groupBy("u").agg(F.min("v").alias("p")), "pointers")
        far = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
        up = materialize(near.join(far, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "pointers")
        lower = up.select(F.col("u").alias("v"), F.col("p").alias("q"))
        rest = materialize(rest.join(up, "u").join(lower, "v", "left")
                           .select(*pair(F.col("p"), F.coalesce("q", "v"))).filter("u <> v").distinct(), "edges")
        step = up.select(F.col("u").alias(component), F.col("p").alias("__up"))
        labels = materialize(labels.join(step, component, "left")
                             .select(node, F.coalesce("__up", component).alias(component)), "labels")
    return labels
