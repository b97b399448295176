"""N-gram Jaccard join by parity sketches: pigeonhole over parts per size band, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.llm.common import bound_batches, chunks, components, distinct_pairs, mix, shingles, table, tasks
from segmentry.session import materialize, release

#: Least parts beyond the pigeonhole's, and differing shingles for one more of them.
SPARE, PER_SPARE = 8, 8
#: Parts without a shingle that a set may hide.
EMPTY = 2
#: Keys of few sets that a pair must share to be compared for them; linked sets that share less share keys of many sets.
TOGETHER = 2
#: Ratio of neighbouring size bands.
BAND = 0.72
#: Sets under one part key that become pairs at once; more are compared in blocks by their sketches.
PAIRED = 3
#: Sets of a block, when the sets under one key or in one cluster are compared.
KEY_BLOCK, SET_BLOCK = 1_024, 1_024
#: Texts of a cluster that one task sets against the cluster's pivot.
TEXT_BLOCK = 256
#: Sets under one key up to which keys are compared many at once, and words of sketches compared at once.
SMALL, COMPARED = 64, 1 << 17
#: Least and most bits of the sketch that whole sets are compared by; in between a bit or two a shingle.
SKETCH_BITS = (256, 16_384)
#: Keys a task gathers before it hands them on, and before it looks for those of several sets.
FLUSH, GATHERED = 200_000, 100_000

_EDGES = [1]
while _EDGES[-1] < 1 << 40:
    _EDGES.append(max(_EDGES[-1] + 1, int(_EDGES[-1] / BAND)))
_EDGES = np.array(_EDGES)
#: Low bits of a key that are hash; the others are its size band.
KEY_BITS = 57


def band_bounds(band: int, percent: int) -> tuple[int, int]:
    """(differing shingles of linked sets at most, keys that linked sets share at least) in a size band."""
    largest = int(_EDGES[band + 1]) - 1
    differ = (100 - percent) * 2 * largest // (100 + percent)
    return differ, SPARE + differ // PER_SPARE + 1 - EMPTY


def node_of(hashes: np.ndarray) -> int:
    """64-bit identity of a set of shingles; equal sets have equal ones."""
    if not len(hashes):
        return 0
    total = np.add.reduce(mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), keepdims=True)
    return int(mix(total ^ mix(np.array([len(hashes)], np.uint64))).view(np.int64)[0])


_ODD = np.uint64(0x9E3779B97F4A7C15)


def sketch_width(size: int) -> int:
    """Bits of the sketch of a set: a power of two."""
    return min(max(1 << max(0, size - 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def sketch_of(hashes: np.ndarray, width: int | None = None) -> np.ndarray:
    """Parity sketch in 64-bit words: every shingle flips one bit."""
    width = width or sketch_width(len(hashes))
    bits = np.bincount((hashes % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches as rows of one width: a wide one folds to what a narrow one would have been."""
    width = min(len(s) for s in sketches)
    return np.stack([np.bitwise_xor.reduce(s.reshape(-1, width), axis=0) for s in sketches])


def _set_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, node, sketch of every document row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, data, offsets in chunks(batch.column(1)) for s in shingles(data, offsets, words)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()),
                pa.array([sketch_of(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n", "node", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, node long, sketch binary")


def part_keys(sets: list[np.ndarray], nodes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, nodes): the part keys of every set in each size band where it may meet a larger set.

    In the band whose largest size is N, linked sets differ in at most D = (100 - p) 2N / (100 + p)
    shingles. A shingle is in one of D + 1 + S parts, so linked sets agree on S + 1 parts at least. The
    key of a part is the XOR of all 64 bits of its shingles: with fewer bits, parts of one or two shingles
    would meet by chance, the more often the more sets there are. Parts without a shingle are no keys, unless
    a set has more than EMPTY of them: then it shows them to its like. So linked sets share S + 1 - EMPTY keys
    at least. The band is in the high bits of a key.
    """
    sizes = np.array([len(s) for s in sets])
    band = np.searchsorted(_EDGES, sizes, "right") - 1
    top = np.searchsorted(_EDGES, sizes * 100 // percent, "right") - 1
    keys, owners = [], []
    for step in range(int((top - band).max(initial=-1)) + 1):
        b = band + step
        largest = _EDGES[b + 1] - 1
        differ = (100 - percent) * 2 * largest // (100 + percent)
        high = b.astype(np.uint64) << np.uint64(KEY_BITS)
        take = np.flatnonzero((b <= top) & (differ > 0) & (sizes > 0))
        if not len(take):
            continue
        flat = np.concatenate([sets[i] for i in take])
        row = np.repeat(np.arange(len(take)), sizes[take])
        parts = (differ[take] + 1 + SPARE + differ[take] // PER_SPARE).astype(np.uint64)
        part = ((flat >> np.uint64(32)) * parts[row]) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
        seen_row, seen_part = row[starts], part[starts]
        salt = mix(b[take].astype(np.uint64) * _ODD)
        value = mix(mix(salt[seen_row] + seen_part) ^ np.bitwise_xor.reduceat(flat, starts))
        keys.append(value >> np.uint64(64 - KEY_BITS) | high[take][seen_row])
        owners.append(nodes[take][seen_row])
        filled = np.bincount(seen_row, minlength=len(take))
        for r in np.flatnonzero(parts.astype(np.int64) - filled > EMPTY):
            empty = np.setdiff1d(np.arange(parts[r], dtype=np.uint64), seen_part[seen_row == r])
            keys.append(~mix(salt[r] + empty) >> np.uint64(64 - KEY_BITS) | high[take[r]])
            owners.append(np.full(len(empty), nodes[take[r]]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _key_rows(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """bucket, keys, nodes: packed part keys; equal (key, node) of a task's flush appear once."""
    def packed(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
        key, node = distinct_pairs(np.concatenate(keys), np.concatenate(nodes))
        bucket = key % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        key, node, bucket = key[order], node[order], bucket[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        ends = np.r_[starts[1:], len(bucket)] if len(bucket) else []
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[starts].astype(np.int32) if len(bucket) else [], pa.int32()),
            pa.array([key[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            pa.array([node[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], names=["bucket", "keys", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, have = [], [], 0
        for batch in batches:
            for _, data, offsets in chunks(batch.column(1)):
                sets = shingles(data, offsets, words)
                k, o = part_keys(sets, np.array([node_of(s) for s in sets], np.int64), percent)
                keys.append(k)
                nodes.append(o)
                have += len(k)
                if have >= FLUSH:
                    yield packed(keys, nodes)
                    keys, nodes, have = [], [], 0
        if have:
            yield packed(keys, nodes)

    return docs.mapInArrow(run, "bucket int, keys binary, nodes binary")


def candidate_pairs(keys: np.ndarray, nodes: np.ndarray) -> tuple[tuple[np.ndarray, ...], ...]:
    """((a, b, shared keys), (key, node, keys, nodes), (node, band, keys)) of keys that two nodes or more have.

    First the pairs under keys of up to PAIRED nodes, then the members of the others (once for keys of a band
    with the same members, with how many they are), last how many keys each node shares in each band.
    """
    keys, nodes = distinct_pairs(keys, nodes)
    n = len(keys)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, PAIRED):
        left = np.flatnonzero((size <= PAIRED) & (np.arange(n) + gap < start + size))
        if not len(left):
            break
        a.append(nodes[left])
        b.append(nodes[left + gap])
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    large = np.flatnonzero(sizes > PAIRED)
    band = keys >> np.uint64(KEY_BITS)
    alike = (np.add.reduceat(mix(nodes.view(np.uint64)), starts) + mix(band[starts] + _ODD))[large] if n else np.zeros(0, np.uint64)
    _, only, times = np.unique(alike, return_index=True, return_counts=True)
    large, counts = large[only], sizes[large[only]]
    begin = np.cumsum(counts) - counts
    many = np.arange(counts.sum()) + np.repeat(starts[large] - begin, counts)
    node, its_band = nodes[size > 1], band[size > 1].view(np.int64)
    order = np.lexsort((its_band, node))
    node, its_band = node[order], its_band[order]
    met = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (its_band[1:] != its_band[:-1])]) if len(node) else np.zeros(0, np.int64)
    return ((a[first], b[first], np.diff(np.r_[first, len(a)])),
            (keys[many].view(np.int64), nodes[many], np.repeat(times, counts), np.repeat(counts, counts)),
            (node[met], its_band[met], np.diff(np.r_[met, len(node)])))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, nodes) of whole buckets, one after the other; small ones together."""
    keys, nodes, have, last = [], [], 0, None
    for batch in batches:
        for bucket, key, node in zip(*(batch.column(c) for c in ("bucket", "keys", "nodes"))):
            if have >= GATHERED and bucket.as_py() != last:
                yield np.concatenate(keys), np.concatenate(nodes)
                keys, nodes, have = [], [], 0
            last = bucket.as_py()
            keys.append(np.frombuffer(key.as_py(), np.uint64))
            nodes.append(np.frombuffer(node.as_py(), np.int64))
            have += len(keys[-1])
    if have:
        yield np.concatenate(keys), np.concatenate(nodes)


def _pair_rows(packed: DataFrame) -> DataFrame:
    """kind, a, b, shared, size: 0 pairs of nodes, 1 keys (a) of many nodes (size) and a node (b), 2 nodes (a) in a band (b).

    shared counts keys: those of the pair, those with the same members, those of the node.
    """
    def rows(kind: int, columns: tuple[np.ndarray | None, ...]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), 50_000):
            n = len(columns[0][at:at + 50_000])
            part = [pa.nulls(n, pa.int64()) if c is None else pa.array(c[at:at + 50_000], pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *part], names=["kind", "a", "b", "shared", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = []
        for keys, nodes in _gathered(batches):
            pairs, many, shared = candidate_pairs(keys, nodes)
            met.append(shared)
            yield from rows(0, (*pairs, None))
            yield from rows(1, many)
        if met:
            node, band, count = (np.concatenate([m[k] for m in met]) for k in range(3))
            order = np.lexsort((band, node))
            node, band, count = node[order], band[order], count[order]
            first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (band[1:] != band[:-1])]) if len(node) else np.zeros(0, np.int64)
            yield from rows(2, (node[first], band[first], np.add.reduceat(count, first) if len(first) else first, None))

    return packed.mapInArrow(run, "kind int, a long, b long, shared long, size long")


def _telling_keys(met: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """key, node of keys of many nodes, without the commonest keys of each node.

    Linked sets that share fewer than TOGETHER keys of few nodes share at least so many keys of many nodes that
    each of them can leave out all but TOGETHER - 1 fewer: the rarest key they share is behind the others in both orders.
    """
    least = F.array(*(F.lit(band_bounds(band, percent)[1]) for band in range(len(_EDGES) - 1)))
    many = (met.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "shared", "size",
                                          F.shiftrightunsigned("a", KEY_BITS).alias("band"))
            .join(able, ["node", "band"], "left_semi"))
    commonest = Window.partitionBy("node", "band").orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, 0)
    return (many.withColumn("left_out", F.sum("shared").over(commonest))
            .filter(F.col("left_out") > least[F.col("band").cast("int")] - TOGETHER).select("key", "node"))


def near_pairs(sketches: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray,
               percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that sketches and sizes do not rule out.

    The Hamming distance of two sketches never exceeds the number of differing shingles.
    """
    alone = left is right
    left, right = (x[np.argsort(sizes[x], kind="stable")] for x in (left, right))
    ordered = sizes[right]
    for at in range(0, len(left), 64):
        rows = left[at:at + 64]
        low = np.searchsorted(ordered, -(-percent * sizes[rows[0]] // 100), "left")
        high = np.searchsorted(ordered, 100 * sizes[rows[-1]] // percent, "right")
        for begin in range(low, high, 1024):
            columns = right[begin:min(high, begin + 1024)]
            distance = np.zeros((len(rows), len(columns)), np.int64)
            for word in range(sketches.shape[1]):
                distance += np.bitwise_count(sketches[rows, word][:, None] ^ sketches[columns, word][None, :])
            a, b = sizes[rows][:, None], sizes[columns][None, :]
            near = ((distance * (100 + percent) <= (100 - percent) * (a + b))
                    & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)))
            if alone:
                near &= rows[:, None] < columns[None, :]
            for x, y in zip(*np.nonzero(near)):
                yield int(rows[x]), int(columns[y])


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members to compare: a block with itself (side 0), or one (1) with another (2)."""
    if (side == 0).all():
        every = np.arange(len(side))
        return every, every
    return np.flatnonzero(side == 1), np.flatnonzero(side == 2)


def _block_rows(members: DataFrame, key: str, size: int, carry: list[str], more: DataFrame | None = None) -> DataFrame:
    """Members of each key in pairs of blocks of about `size`: key, low, high, side and `carry`, sorted by block.

    What a node carries may come from `more`: it is joined last, so that it is shuffled by block only; members
    that it lacks are left out.
    """
    count = (members.groupBy(key).agg(F.count(F.lit(1)).alias("n_members")).filter("n_members > 1")
             .select(key, F.ceil(F.col("n_members") / size).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    at = [key, "low", "high"]
    rows = (members.join(count, key).withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(key, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), side.alias("side"),
                    *(carry if more is None else ["node"])))
    if more is not None:
        rows = rows.join(more.select(*carry), "node").select(*at, "side", *carry)
    return rows.repartition(tasks(members.sparkSession), *at).sortWithinPartitions(*at, "node")


def _each_block(batches: Iterator[pa.RecordBatch], key: str, carry: list[str]) -> Iterator[list[tuple]]:
    """The rows (side, *carry) of one block pair after the other."""
    now, rows = None, []
    for batch in batches:
        for *block, side, rest in zip(*(batch.column(n).to_pylist() for n in (key, "low", "high", "side")),
                                      zip(*(batch.column(n).to_pylist() for n in carry))):
            if block != now and rows:
                yield rows
                rows = []
            now = block
            rows.append((side, *rest))
    if rows:
        yield rows


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit words of a column of sketches, and the first word and the number of words of each."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.uint64)
    return data, (ends[:-1] - ends[0]) // 8, np.diff(ends) // 8


def near_mask(words: tuple[np.ndarray, np.ndarray, np.ndarray], sizes: np.ndarray, a: np.ndarray, b: np.ndarray,
              percent: int) -> np.ndarray:
    """Which pairs of rows (a, b) sketches and sizes do not rule out; pairs of equal widths are compared at once."""
    data, first, width = words
    wide = width[a] > width[b]
    a, b = np.where(wide, b, a), np.where(wide, a, b)
    near = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
    left = np.flatnonzero(near)
    kinds, kind = np.unique(np.stack([width[a[left]], width[b[left]]]), axis=1, return_inverse=True)
    for k, (low, high) in enumerate(kinds.T):
        alike = left[kind == k]
        step = max(1, COMPARED // int(high))
        for at in range(0, len(alike), step):
            pair = alike[at:at + step]
            one = data[first[a[pair]][:, None] + np.arange(low)]
            two = data[first[b[pair]][:, None] + np.arange(high)].reshape(len(pair), high // low, low)
            distance = np.bitwise_count(one ^ np.bitwise_xor.reduce(two, axis=1)).sum(axis=1, dtype=np.int64)
            near[pair] = distance * (100 + percent) <= (100 - percent) * (sizes[a[pair]] + sizes[b[pair]])
    return near


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, first row of each group) of whole groups equal in `by`; the last group of a batch waits for the next."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        at = [rows[n].to_numpy() for n in by]
        starts = np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in at], axis=0)])
        if len(starts) > 1:
            yield rows.slice(0, starts[-1]), starts[:-1]
        rest = rows.slice(starts[-1])
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _sketch_links(blocks: DataFrame, key: str, percent: int) -> DataFrame:
    """a, b: links that join what the sketches under one key do not rule out; never all pairs.

    Blocks of up to SMALL sets are compared together, a batch of rows at once; larger ones one by one.
    """
    def small_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end, place = np.repeat(starts + sizes, sizes), np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)])
        lefts = [place[place + gap < end] for gap in range(1, int(sizes.max()))]
        return np.concatenate([place[:0], *lefts]), np.concatenate([place[:0], *(x + gap for gap, x in enumerate(lefts, 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_groups(batches, [key, "low", "high"]):
            node, n, side = (rows[c].to_numpy() for c in ("node", "n", "side"))
            words = _words(rows["sketch"])
            sizes = np.diff(np.r_[starts, len(node)])
            small = (sizes <= SMALL) & (np.maximum.reduceat(side, starts) == 0)
            found = []
            if small.any():
                a, b = small_pairs(starts[small], sizes[small])
                near = near_mask(words, n, a, b, percent)
                found += zip(node[a[near]].tolist(), node[b[near]].tolist())
            data, first, width = words
            for at, count in zip(starts[~small], sizes[~small]):
                part = slice(at, at + count)
                sketches = folded([data[f:f + w] for f, w in zip(first[part], width[part])])
                found += ((int(node[at + x]), int(node[at + y])) for x, y in _joining(near_pairs(sketches, n[part], *_sides(side[part]), percent), count))
            names = {x: i for i, x in enumerate(dict.fromkeys(x for pair in found for x in pair))}
            back = list(names)
            links = [(back[i], back[j]) for i, j in _joining(((names[x], names[y]) for x, y in found), len(names))]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _joining(pairs: Iterator[tuple[int, int]], n: int) -> Iterator[tuple[int, int]]:
    """The pairs of 0..n-1 that join what earlier pairs have not joined."""
    forest = _Forest(n)
    for x, y in pairs:
        i, j = forest.root(x), forest.root(y)
        if i != j:
            forest.up[i] = j
            yield x, y


def _near_rows(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs that their sketches (sa, sb) and sizes (na, nb) do not rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words = _words(pa.chunked_array([batch.column("sa"), batch.column("sb")]))
            sizes = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
            near = near_mask(words, sizes, np.arange(rows), np.arange(rows, 2 * rows), percent)
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


class _Forest:
    """Union-find over the members of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def verified_links(deltas: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join the members of a block as all its links would; exact on the sets.

    A delta holds the shingles that only a set or only the pivot has, so two sets differ in as many shingles as
    their deltas do. Of what the sketches of the deltas do not rule out, a pair is checked unless checked links
    join it already.
    """
    forest, links = _Forest(len(deltas)), []
    if not len(left) or not len(right):
        return links
    width = sketch_width(max(len(d) for d in deltas))
    for i, j in near_pairs(np.stack([sketch_of(d, width) for d in deltas]), sizes, left, right, percent):
        if forest.root(i) == forest.root(j):
            continue
        differ = len(np.setxor1d(deltas[i], deltas[j], assume_unique=True))
        both = int(sizes[i] + sizes[j])
        if 100 * (both - differ) >= percent * (both + differ):  # twice the shared ones and the union
            forest.up[forest.root(i)] = forest.root(j)
            links.append((i, j))
    return links


def _link_rows(blocks: DataFrame, percent: int) -> DataFrame:
    """a, b (document ids) of verified links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_block(batches, "cluster", ["doc_id", "n", "delta"]):
            side, ids, sizes, deltas = zip(*rows)
            found = verified_links([np.frombuffer(d, np.uint64) for d in deltas], np.array(sizes), *_sides(np.array(side)), percent)
            yield pa.RecordBatch.from_arrays([pa.array([ids[e[k]] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _against_pivots(members: DataFrame) -> DataFrame:
    """Members of clusters of two or more with `part` and `pivots`: each is set against its cluster's pivot in one part.

    The pivot, the member of least doc_id, goes to every part of its cluster.
    """
    clusters = (members.groupBy("cluster").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1")
                .select("cluster", "pivot", F.ceil(F.col("size") / TEXT_BLOCK).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    own = F.array(F.struct(part.alias("part"), F.lit(False).alias("is_pivot")))
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("is_pivot")))
    return members.join(clusters, "cluster").select(
        "cluster", "node", "doc_id", F.when(F.col("doc_id") == F.col("pivot"), F.concat(every, own)).otherwise(own).alias("places"))


def _delta_rows(texts: DataFrame, words: int) -> DataFrame:
    """cluster, node, doc_id, n, delta of every member: the shingles that only it or only the pivot has.

    Rows arrive by cluster and part, the pivot first. Of several texts under one doc_id only the node's own
    counts, and of equal ones one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot, last = None, None, None
        for batch in batches:
            out = []
            sets = (s for _, data, offsets in chunks(batch.column("text")) for s in shingles(data, offsets, words))
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "part", "is_pivot", "node", "doc_id")))
            for (cluster, part, is_pivot, node, doc_id), own in zip(keys, sets):
                if node_of(own) != node:
                    continue
                if (cluster, part) != now:
                    now, pivot, last = (cluster, part), None, None
                if is_pivot:
                    pivot = own
                elif node != last:
                    last = node
                    out.append((cluster, node, doc_id, len(own), np.setxor1d(own, pivot, assume_unique=True).tobytes()))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())],
                                             names=["cluster", "node", "doc_id", "n", "delta"])

    return texts.mapInArrow(run, "cluster long, node long, doc_id long, n long, delta binary")


def join(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document row.

    Words are runs of other than white space, A-Z lower-cased. Documents whose sets of `words`-word
    shingles have 100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id reachable. Null, empty and blank texts have no shingle and are alone. Repeated rows and
    equal sets are one node. Rows without doc_id count
    in no minimum; with others of their set they get its component, else null.

    Equal sets collapse first, so groups of copies of any size are one node. Part keys travel packed.
    Linked sets share many of them, so each set leaves out its commonest keys (shared passages) in a fixed order.
    Pairs under a key must also pass the comparison of whole sketches; under a key of many nodes (a
    common passage, many near copies) that runs as pairs of blocks in many tasks, which return links
    enough to join what passes, never all pairs. What is joined so is a candidate cluster. Its texts meet
    the text of one member, the pivot, and leave as the shingles in which they differ from it; these are
    compared, again as pairs of blocks, and the links verified exactly.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = materialize(_set_rows(given, words), "sets")
    nodes = materialize(sets.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct(
        "doc_id", "n", "sketch")).alias("x")).select("node", F.col("x.doc_id").alias("first"), "x.n", "x.sketch"), "nodes")

    packed = _key_rows(given, words, percent, 8 * tasks(spark)).repartition(tasks(spark), "bucket").sortWithinPartitions("bucket")
    met = materialize(_pair_rows(packed), "met")
    # a node that shares fewer keys of a band with all others than linked sets share is linked with nothing there
    least = F.array(*(F.lit(band_bounds(band, percent)[1]) for band in range(len(_EDGES) - 1)))
    bands = materialize(met.filter("kind = 2").groupBy(F.col("a").alias("node"), F.col("b").alias("band"))
                        .agg(F.sum("shared").alias("keys")).filter(F.col("keys") >= least[F.col("band").cast("int")])
                        .select("node", "band"), "bands")
    able = materialize(nodes.join(bands, "node", "left_semi"), "able")
    of = lambda side: able.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
    pairs = (met.filter("kind = 0").groupBy("a", "b").agg(F.sum("shared").alias("shared")).filter(F.col("shared") >= TOGETHER)
             .join(of("a"), "a").join(of("b"), "b"))
    many = materialize(_telling_keys(met, bands, percent), "many")
    dense = _sketch_links(_block_rows(many, "key", KEY_BLOCK, ["node", "n", "sketch"], able), "key", percent)
    clusters = components(_near_rows(pairs, percent).unionByName(dense), "a", "b", "node", "cluster")
    release(met, many)

    members = materialize(_against_pivots(clusters.join(nodes.select("node", F.col("first").alias("doc_id")), "node")), "members")
    at = ["cluster", "part"]
    texts = (given.join(members, "doc_id").withColumn("place", F.explode("places"))
             .select("cluster", "place.part", "place.is_pivot", "node", "doc_id", "text")
             .repartition(tasks(spark), *at).sortWithinPartitions(*at, F.desc("is_pivot"), "node"))
    deltas = materialize(_delta_rows(texts, words), "deltas")
    links = _link_rows(_block_rows(deltas, "cluster", SET_BLOCK, ["node", "doc_id", "n", "delta"]), percent)
    reached = components(links, "a", "b", "first", "component")

    return (sets.drop("sketch").join(nodes.select("node", "first"), "node", "left").join(reached, "first", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("component", "first")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with the smallest doc_id of each component; rows without doc_id stay.

    Rows that repeat a doc_id are taken for one document. The ids to go are stored first: Spark
    broadcasts them only if their files are small.
    """
    found = join(docs, words, percent)
    gone = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "copies")
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """All documents by 4-word shingles at 85 percent."""
    return join(table(spark, folder, "documents"), words=4, percent=85)


_WORDS = (r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')")
OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM overlap JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.r) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id"""
