"""Suffix-array dedup: longest-previous-factor arrays over anchored contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.llm.common import CHUNK_BYTES, RangeHash, bound_batches, chunks, mix, table, tasks
from segmentry.session import materialize

#: Bytes of the shortest repeat.
LENGTH = 400
#: Bytes of the string an anchor is chosen by.
GRAM = 32
#: Contexts of one anchor that one task sorts; anchors with more are split by content.
GROUP = 2_000
#: Bytes of text whose anchors are looked for at once, besides a single longer text.
ANCHORED_BYTES = 50_000
#: Bytes of contexts that are suffix-sorted at once, besides one anchor's own.
SORTED_BYTES = 100_000
#: Neighbouring windows that share a key at each split; at 1 equal keys are equal strings.
WIDTHS = (LENGTH - GRAM + 1, 48, 6, 1)

_ROWS = "h long, c long, doc_id long, row long, start long, shift int, width int, size int"


# --- suffix order and previous factors ------------------------------------------------------

def prefix_classes(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the `length`-byte string at every position: equal strings have equal ranks.

    Prefix doubling: ranks of 2k bytes order pairs of ranks of k bytes; the last step overlaps. Ranks
    follow byte order, so they give the suffix order up to `length`. Positions near the end count as
    followed by something smaller than any byte.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = data.astype(np.uint64) + np.uint64(1)
    key = padded[:n].copy()
    for i in range(1, 6):
        key = key * np.uint64(257) + padded[i:n + i]
    rank, have = _dense(key), 6
    while have < length and n:
        step = min(have, length - have)
        after = np.zeros(n, np.int64)
        after[:max(0, n - step)] = rank[step:] + 1
        rank = _dense(rank * np.int64(n + 2) + after)
        have += step
    return rank


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key)  # the order of equal keys does not matter
    ordered = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]]) if len(key) else order
    return rank


def previous_and_next_smaller(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix order, the nearest places before and after it with a smaller position (-1, n: none)."""
    def before(values: np.ndarray) -> np.ndarray:
        near = np.arange(len(values)) - 1
        open_ = np.flatnonzero(near >= 0)
        while len(open_):
            open_ = open_[values[near[open_]] > values[open_]]
            near[open_] = near[near[open_]]
            open_ = open_[near[open_] >= 0]
        return near

    return before(positions), len(positions) - 1 - before(positions[::-1])[::-1]


def earlier_copies(classes: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor at each given position has the whole class length.

    The longest previous factor of a suffix begins at its previous or next smaller position in suffix
    order; it is long enough if that has the same class.
    """
    order = np.argsort(classes[positions] * np.int64(len(classes)) + positions)
    place = positions[order]
    found = np.zeros(len(place), bool)
    for near in previous_and_next_smaller(place):
        inside = (near >= 0) & (near < len(place))
        other = place[np.where(inside, near, 0)]
        found |= inside & (classes[other] == classes[place])
    out = np.zeros(len(place), bool)
    out[order] = found
    return out


# --- anchors --------------------------------------------------------------------------------

def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): runs of window starts whose LENGTH bytes have the same anchor.

    The anchor of a window is its GRAM-byte string with the smallest hash, the leftmost of equals, so
    equal windows have equal anchors at equal distances. Windows never cross rows.
    """
    n, w = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(n - GRAM + 1)
    low = (RangeHash(data)(at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    pad = -len(low) % w
    blocks = np.r_[low, np.full(pad, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - LENGTH + 1)
    chosen = (np.minimum(right[starts], left[starts + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = row[starts] == row[starts + LENGTH - 1]
    starts, chosen = starts[valid], chosen[valid]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[first[1:], len(starts)] - 1
    return chosen[first], starts[first], starts[last]


def split(data: np.ndarray, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Items: windows of one anchor whose distance from it falls into one block of `width`.

    h is the hash of the bytes that all windows of the block have (and of the block), c of all bytes that
    the item's windows cover. Equal windows are in items of equal h; items of equal c are equal.
    """
    far, near = anchor - first, anchor - last
    count = far // width - near // width + 1
    item = np.repeat(np.arange(len(anchor)), count)
    block = near[item] // width + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    low, high = np.maximum(near[item], block * width), np.minimum(far[item], (block + 1) * width - 1)
    start, stop = anchor[item] - high, anchor[item] - low  # window starts, both included
    core = anchor[item] - block * width
    ranges = RangeHash(data)
    h = mix(ranges(core, core - width + 1 + LENGTH) + block.astype(np.uint64))
    c = mix(ranges(start, stop + LENGTH) + mix(high.astype(np.uint64)))
    return {"h": h.view(np.int64), "c": c.view(np.int64), "start": start, "shift": high.astype(np.int32),
            "width": (stop - start + 1).astype(np.int32), "item": item}


def _segments(offsets: np.ndarray, base: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, from, to, window starts before `to` that count) of one long row in overlapping pieces."""
    size = offsets[1] - offsets[0]
    for a in range(0, max(1, size - LENGTH + 1), CHUNK_BYTES):
        yield base, a, min(size, a + CHUNK_BYTES + LENGTH - 1), a


#: What tells document rows apart: both come from the data alone, so every scan gives a row the same key.
_ROW = ("doc_id", "row")
#: Stands for a null id inside.
_NO_ID = -2**63


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """One row per anchor of every document row: h, c, where its windows begin."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for base, data, offsets in chunks(batch.column(2), ANCHORED_BYTES):
                pieces = ([(data[a:b], np.array([0, b - a]), a) for _, a, b, _ in _segments(offsets, base)]
                          if len(offsets) == 2 else [(data, offsets, 0)])
                for part, edges, skipped in pieces:
                    anchor, first, last = anchors(part, edges)
                    got = split(part, anchor, first, last, WIDTHS[0])
                    row = np.searchsorted(edges, first, "right") - 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array(got["h"]), pa.array(got["c"]), pa.array(ids[base + row]),
                        pa.array(rows[base + row]), pa.array(got["start"] - edges[row] + skipped), pa.array(got["shift"]),
                        pa.array(got["width"]), pa.array(got["width"] + np.int32(LENGTH - 1))],
                        names=["h", "c", "doc_id", "row", "start", "shift", "width", "size"])

    return docs.mapInArrow(run, _ROWS)


def _resplit(items: DataFrame, width: int) -> DataFrame:
    """The items of anchors with too many contexts, split by a narrower block; contexts go along."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data, offsets in chunks(batch.column("context")):
                here = slice(base, base + len(offsets) - 1)
                start, shift, wide = (np.asarray(batch.column(n))[here].astype(np.int64) for n in ("start", "shift", "width"))
                got = split(data, offsets[:-1] + shift, offsets[:-1], offsets[:-1] + wide - 1, width)
                of, inside = got["item"], got["start"] - offsets[:-1][got["item"]]
                size = got["width"] + np.int32(LENGTH - 1)
                bytes_ = [data[a:a + n].tobytes() for a, n in zip(got["start"], size)]
                take = pa.array(of + base)
                yield pa.RecordBatch.from_arrays([
                    pa.array(got["h"]), pa.array(got["c"]), batch.column("doc_id").take(take), batch.column("row").take(take),
                    pa.array(start[of] + inside), pa.array(got["shift"]), pa.array(got["width"]), pa.array(size),
                    pa.array(bytes_, pa.binary())],
                    names=["h", "c", "doc_id", "row", "start", "shift", "width", "size", "context"])

    return items.mapInArrow(run, _ROWS + ", context binary")


def _sorted_rows(contexts: DataFrame, keep_first: bool) -> DataFrame:
    """doc_id, row, begin, end of repeats among the contexts of each anchor; rows arrive sorted by h, doc_id, row, start."""
    def repeats(batch: list[tuple]) -> pa.RecordBatch:
        texts = [b[5] for b in batch]
        sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        wide = sizes - LENGTH + 1
        classes = prefix_classes(data, LENGTH)
        at = np.repeat(begins, wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        hit = earlier_copies(classes, at)
        if not keep_first:  # a later copy is an earlier one in the mirrored order
            mirrored = classes[::-1]
            hit |= earlier_copies(mirrored, len(data) - 1 - at[::-1])[::-1]
        owner = np.repeat(np.arange(len(batch)), wide)
        inside = at - begins[owner]
        picked = np.flatnonzero(hit)
        o, p = owner[picked], inside[picked]
        first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)]) if len(o) else o
        last = np.r_[first[1:], len(o)] - 1 if len(o) else o
        ids, rows, starts = (np.array([b[i] for b in batch]) for i in (1, 2, 3))
        return pa.RecordBatch.from_arrays([
            pa.array(ids[o[first]], pa.int64()), pa.array(rows[o[first]], pa.int64()), pa.array(starts[o[first]] + p[first], pa.int64()),
            pa.array(starts[o[last]] + p[last] + LENGTH, pa.int64())], names=["doc_id", "row", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            for item in zip(*(batch.column(n).to_pylist() for n in ("h", "doc_id", "row", "start", "width", "context"))):
                if held and item[:4] == held[-1][:4]:  # of a row that is there twice
                    continue
                if item[0] != key and size > SORTED_BYTES:
                    yield repeats(held)
                    held, size = [], 0
                key = item[0]
                held.append(item)
                size += len(item[5])
        if held:
            yield repeats(held)

    return contexts.mapInArrow(run, "doc_id long, row long, begin long, end long")


def _round(items: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """(spans known already, items whose contexts must be compared) of stored items.

    Items of equal c are equal: all are repeats, and the first stands for them in the comparison, if
    any other context has the same anchor.
    """
    place = F.struct(*_ROW, "start")
    equal = materialize(items.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), "equal")
    known = items.join(equal.filter("n > 1").select("h", "c", "first"), ["h", "c"])
    if keep_first:
        known = known.filter(F.col("first") != place)
    spans = known.select(*_ROW, F.col("start").alias("begin"), (F.col("start") + F.col("size")).alias("end"))
    anchors_ = equal.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    compare = equal.join(anchors_, "h").select("h", "c", "contexts", "first.doc_id", "first.row", "first.start")
    return spans, compare


def _contexts(compare: DataFrame, items: DataFrame) -> DataFrame:
    """The items to compare, one of each place: rows equal in id and text have the same places."""
    keys = ["h", "c", *_ROW, "start"]
    return materialize(compare.join(items, keys).dropDuplicates(keys), "contexts")


def repeated_spans(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """doc_id, row, begin, end (bytes, may overlap) of repeats; docs has doc_id, row, text.

    Windows of LENGTH bytes are grouped by anchors; only anchors that occur again are followed. Contexts
    of an anchor are suffix-sorted together. An anchor with more than GROUP contexts is split by the
    content of narrower blocks of windows, down to single windows, where counting is exact, so no
    group outgrows a task.
    """
    items = _anchor_rows(docs)
    # stored first, so that the join deals both sides itself and a hot anchor can be split
    again = materialize(items.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "again")
    items = materialize(items.join(again, "h"), "anchors")
    out = []
    spans, compare = _round(items, keep_first)
    out.append(spans)
    wanted = _contexts(compare, items)
    cuts = wanted.groupBy(*_ROW).agg(F.collect_list(F.struct("h", "contexts", "start", "shift", "width", "size")).alias("cuts"))
    text = F.encode("text", "utf-8")
    held = docs.join(cuts, list(_ROW)).select(*_ROW, text.alias("bytes"), F.explode("cuts").alias("cut")).select(
        *_ROW, "cut.*", F.expr("substring(bytes, cut.start + 1, cut.size)").alias("context"))
    held = materialize(held, "contexts")
    for width in (*WIDTHS[1:], None):
        small = held.filter(F.col("contexts") <= GROUP)
        out.append(_sorted_rows(small.repartition(tasks(docs.sparkSession), "h").sortWithinPartitions("h", *_ROW, "start"), keep_first))
        large = held.filter(F.col("contexts") > GROUP)
        if width is None or large.isEmpty():
            break
        items = materialize(_resplit(large.drop("contexts", "h"), width), "anchors")
        spans, compare = _round(items.drop("context"), keep_first)
        out.append(spans)
        held = _contexts(compare, items)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def remove_repeats(docs: DataFrame, keep_first: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every document row.

    Texts are UTF-8 bytes, null is empty. A byte goes if a LENGTH-byte string over it also begins
    earlier (smaller doc_id, null first, then hash of the text, then offset), or, without `keep_first`,
    anywhere else. Overlapping copies count and all strings are judged on the input. Texts shorter than
    LENGTH stay whole. Of rows equal in id and text one is the first, the others copies of it.

    A row is known by its id and a hash of its text, so that scans dealt out differently, as after a lost
    executor, agree on it.
    """
    bound_batches(docs.sparkSession)
    given = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    given = given.withColumn("row", F.xxhash64("text")).select(*_ROW, "text")
    spans = repeated_spans(given, keep_first).groupBy(*_ROW).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = given.join(spans, list(_ROW), "left")
    if keep_first:  # all but one of equal rows go whole
        twins = materialize(given.groupBy(*_ROW).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*_ROW), "twins")
        once = Window.partitionBy(*_ROW).orderBy("row")
        whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.octet_length("text").cast("long").alias("end")))
        copy = (F.row_number().over(once) > 1) & (F.octet_length("text") >= LENGTH)
        paired = joined.join(twins, list(_ROW), "left_semi").withColumn("spans", F.when(copy, whole).otherwise(F.col("spans")))
        joined = joined.join(twins, list(_ROW), "left_anti").unionByName(paired)
    joined = joined.select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_cut(t.encode(), s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            columns = list(zip(*out)) if out else [()] * 4
            ids = [None if i == _NO_ID else i for i in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]),
                                              pa.array(columns[3], pa.binary())],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def _cut(data: bytes, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    merged: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    kept, at = [], 0
    for begin, end in merged:
        kept.append(data[at:begin])
        at = end
    kept.append(data[at:])
    left = b"".join(kept)
    return len(data), len(data) - len(left), len(merged), left


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the bytes of strings that begin anywhere else too."""
    found = remove_repeats(table(spark, folder, "documents"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
