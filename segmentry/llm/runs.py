"""Periodic runs of words: branching-tandem test on an enhanced suffix array."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.common import bound_batches, table

#: A run has at least this many periods and at least this many words.
PERIODS, SHORTEST = 4, 6
#: Words of texts whose suffixes are sorted at once, besides a single longer text.
CHUNK_WORDS = 50_000
#: Suffixes whose neighbours one distance away are looked up at once.
LOOKED_UP = 1_000_000

#: Rewrites the words of a text (id, words) before runs are sought.
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


# --- enhanced suffix array ------------------------------------------------------------------

def suffix_order(keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in suffix order, and ranks by level: equal ranks at level k are equal strings of 2**k keys.

    Prefix doubling over the suffixes that still tie. Keys that occur once end every tie, so with one at the
    end of each text no tie reaches over it. No two suffixes tie on the last level.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank, tied = np.empty(n, np.int64), np.arange(n)
    levels: list[np.ndarray] = []
    key = keys[order]
    while True:
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(key)])
        rank[order[tied]] = np.repeat(tied[first], size)
        levels.append(rank.astype(np.int32))
        tied = tied[np.repeat(size > 1, size)]
        if not len(tied):
            return order, levels
        place = order[tied]
        key = rank[place] * np.int64(n) + rank[place + (1 << (len(levels) - 1))]
        sort = np.argsort(key, kind="stable")
        order[tied], key = place[sort], key[sort]


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Longest common prefix of each suffix and the next one in suffix order."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    at = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    a, b = order[at], order[at + 1]
    for k in range(len(levels) - 1, -1, -1):
        step = np.where(levels[k][a] == levels[k][b], 1 << k, 0)
        a, b = a + step, b + step
        out[at] += step
    return out


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, first, last): for each place with a common prefix, the suffixes that share it.

    Node x parts first..x from x+1..last: every suffix of the one side has exactly lcp[x] keys in common with
    every one of the other. Equal neighbours are parted from the left, so an interval with c children
    counts as c - 1 nodes. Minima of 2**k places lead to the borders.
    """
    node = np.flatnonzero(lcp > 0)
    if not len(node):
        return node, node, node
    stretch = np.diff(np.r_[-1, np.flatnonzero(lcp == 0), len(lcp)]).max()
    low = [lcp]
    while (1 << len(low)) <= stretch:
        half = 1 << (len(low) - 1)
        low.append(np.minimum(low[-1][:-half], low[-1][half:]))
    depth, first, last = lcp[node], node.copy(), node + 1
    for k in range(len(low) - 1, -1, -1):
        size = len(low[k])
        fits = (first >= 1 << k) & (low[k][np.clip(first - (1 << k), 0, size - 1)] > depth)
        first = first - np.where(fits, 1 << k, 0)
        fits = (last < size) & (low[k][np.minimum(last, size - 1)] >= depth)
        last = last + np.where(fits, 1 << k, 0)
    return node, first, last


def branching_squares(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, depth) of strings ww, w of `depth` keys, that cannot be moved one key to the right.

    The suffixes of the smaller side of a node are looked up `depth` ahead and `depth` behind: there is
    such a string where the other one's rank lies on the node's other side. Sides halve, so a suffix is
    looked up a logarithmic number of times at most. A run of PERIODS periods has as many suffixes in the
    interval, so smaller intervals are passed over.
    """
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    node, first, last = lcp_intervals(lcp)
    wide = last - first + 1 >= PERIODS
    node, first, last = node[wide], first[wide], last[wide]
    left = node - first + 1 <= last - node
    low, size = np.where(left, first, node + 1), np.where(left, node - first + 1, last - node)
    there, until = np.where(left, node + 1, first), np.where(left, last, node)
    upto = np.cumsum(size)
    places, depths, done = [], [], 0
    while done < len(node):
        stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + LOOKED_UP, "right")))
        of = np.repeat(np.arange(done, stop), size[done:stop])
        slot = low[of] + np.arange(len(of)) - np.repeat(upto[done:stop] - size[done:stop] - (upto[done] - size[done]), size[done:stop])
        i, depth = order[slot], lcp[node[of]]
        for j, begin in ((i + depth, i), (i - depth, i - depth)):
            other = rank[np.maximum(j, 0)]
            hit = (j >= 0) & (other >= there[of]) & (other <= until[of])
            places.append(begin[hit])
            depths.append(depth[hit])
        done = stop
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *places]), np.concatenate([empty, *depths])


def find_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; each text in `keys` ends with a key of its own.

    Every run ends with a branching square of its period. Each such square that has PERIODS periods is moved
    left as far as its period holds; squares of multiples of the period arrive at the same run.
    """
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    order, levels = suffix_order(keys)
    at, period = branching_squares(order, common_prefixes(order, levels))
    # the periods before the square: two strings one period apart agree if their two overlapping powers of two do
    start = at - (PERIODS - 2) * period
    keep = start >= 0
    at, period, start = at[keep], period[keep], start[keep]
    size = (PERIODS - 1) * period
    level = np.frexp(size.astype(np.float64))[1] - 1
    keep = np.zeros(len(at), bool)
    for k in np.unique(level[level < len(levels)]):
        here = np.flatnonzero(level == k)
        a, p = start[here], period[here]
        b = a + size[here] - (1 << int(k))
        keep[here] = (levels[k][a] == levels[k][a + p]) & (levels[k][b] == levels[k][b + p])
    at, period, start = at[keep], period[keep], start[keep]
    for k in range(len(levels) - 1, -1, -1):
        back = np.maximum(start - (1 << k), 0)
        same = (start >= 1 << k) & (levels[k][back] == levels[k][np.minimum(back + period, len(keys) - 1)])
        start = start - np.where(same, 1 << k, 0)
    end = at + 2 * period
    keep = end - start >= SHORTEST
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.zeros(0, bool)
    start, end, period = start[least], end[least], period[least]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


# --- documents ------------------------------------------------------------------------------

def _word_runs(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """Per text: its runs as (start, length, period), and the words that stay."""
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number)) for words in texts for w in words]
    sizes = np.array([len(words) for words in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1  # where each text's own key stands
    keys = np.empty(len(flat) + len(texts), np.int64)
    inside = np.ones(len(keys), bool)
    inside[ends] = False
    keys[inside] = flat
    keys[ends] = len(number)
    keys += np.repeat(np.arange(len(texts)), sizes + 1) * np.int64(len(number) + 1)
    start, end, period = find_runs(keys)
    drop = np.zeros(len(keys) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, end, -1)
    stays = np.cumsum(drop)[:-1] == 0
    bounds = np.searchsorted(start, np.r_[ends - sizes, len(keys)])
    for t, words in enumerate(texts):
        begin, here = ends[t] - sizes[t], slice(bounds[t], bounds[t + 1])
        found = list(zip((start[here] - begin).tolist(), (end[here] - start[here]).tolist(), period[here].tolist()))
        kept = words if not found else [w for w, stay in zip(words, stays[begin:ends[t]].tolist()) if stay]
        yield found, kept


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs as array of struct(start, length, period), collapsed text of every document row.

    Words are the stretches between space and the control characters 9 to 13, told apart by case. A run is a
    longest stretch that repeats its smallest period PERIODS times or more and has SHORTEST words or more;
    runs are ordered by start, then period. `collapsed` joins by one space the words that no run holds
    after its first period. Null or empty text has no words, no runs and an empty result; ties and repeated
    rows are rows of their own, other columns are ignored. `rewrite` may change the words beforehand.

    Texts stay where they are read: no shuffle. A task sorts the suffixes of some CHUNK_WORDS words at
    once, or of one longer text, in memory linear in its words.
    """
    bound_batches(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[list, list[list[bytes]]]]:
        ids, held, size = [], [], 0
        for i, t in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
            words = (t.as_py() or b"").split()
            ids.append(i.as_py())
            held.append(rewrite(ids[-1], words) if rewrite else words)
            size += len(words)
            if size >= CHUNK_WORDS:
                yield ids, held
                ids, held, size = [], [], 0
        if ids:
            yield ids, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in batches_of(batch):
                found, kept = zip(*_word_runs(texts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], run_type),
                    pa.array([b" ".join(k) for k in kept], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return given.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words op13 looks at: of each document whose crc32 ends with 0, the tail repeats a stretch; null ids stay."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every whole document, the longest one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(table(spark, folder, "documents"), rewrite=repeated_tail)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *(r[n].cast("string") for n in ("start", "length", "period"))), F.lit("\n"))), "")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
