"""Embedding near-dedup: sorted projection passes with bounded windows, verified by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.common import bound_batches, components, table, tasks
from segmentry.session import materialize

#: Passes of a label at least and at most, bits of a pass's concatenated hash, and vectors of a block; a window is two blocks.
PASSES, MOST_PASSES, BITS, BLOCK = 24, 160, 48, 256
#: Chance to miss a pair just at COSINE that a label's passes are chosen for.
MISSED = 0.02
COSINE = 0.98
SEED = 20240611


def _unit(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, unit vectors in double precision) of usable vectors of one length."""
    good, out = [], []
    for i, values in enumerate(column.to_pylist()):
        if not values or any(x is None for x in values):
            continue
        v = np.array(values, np.float64)
        if np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
            v = v / top  # no overflow in the length
            good.append(i)
            out.append(v / np.linalg.norm(v))
    return np.array(good, np.int64), out


def _pass_rows(vectors: DataFrame) -> DataFrame:
    """label, node, unit, one per usable vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, unit = _unit(batch.column("embedding"))
            rows = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("label"),
                                              pa.array([u.tobytes() for u in unit], pa.binary())],
                                             names=["vec_id", "label", "unit"])

    return vectors.mapInArrow(run, "vec_id long, label string, unit binary")


def _label_means(nodes: DataFrame) -> DataFrame:
    """label, size, mean, passes: mean unit vector of each label and length, and the passes it takes.

    Vectors of a label may lie in a narrow cone, where signs of random planes tell them apart badly; around
    the label's mean they spread. If r is the mean squared distance to the mean, two vectors of cosine c
    have cosine 1 - (1 - c) / r there, agree in a bit with the chance that their angle gives, and meet in a
    window if they agree in as many bits as halve the label down to a window.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for batch in batches:
            for label, unit in zip(batch.column("label").to_pylist(), batch.column("unit").to_pylist()):
                held = sums.setdefault((label, len(unit) // 8), [0, np.zeros(len(unit) // 8)])
                held[0] += 1
                held[1] += np.frombuffer(unit, np.float64)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()),
            pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.list_(pa.float64()))],
            names=["label", "size", "n", "part"])

    stats = nodes.select("label", "unit").mapInArrow(run, "label string, size int, n long, part array<double>").groupBy("label", "size").agg(
        F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("s"))
    mean = F.transform("s", lambda x: x / F.col("n"))
    spread = F.greatest(1 - F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x), F.lit(1e-9))
    agree = 1 - F.acos(F.greatest(1 - (1 - COSINE) / F.col("spread"), F.lit(-1.0))) / np.pi
    meet = F.pow(F.col("agree"), F.log2(F.greatest(F.col("n") / BLOCK, F.lit(1.0))))
    needed = F.ceil(F.log(F.lit(MISSED)) / F.log(1 - F.least(F.col("meet"), F.lit(0.99))))
    return (stats.withColumn("mean", mean).withColumn("spread", spread).withColumn("agree", agree).withColumn("meet", meet)
            .select("label", "size", "mean", F.least(F.greatest(needed, F.lit(PASSES)), F.lit(MOST_PASSES)).cast("int").alias("passes")))


def _hash_rows(nodes: DataFrame) -> DataFrame:
    """label, size, trip, code, node, unit: the sort key of every node in every pass, from its offset to the label's mean."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @cache
        def plane(size: int, trip: int) -> np.ndarray:
            return np.random.default_rng([SEED, size, trip]).standard_normal((size, BITS))

        weight = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for whole in batches:
            sizes, passes = (whole.column(c).to_numpy() for c in ("size", "passes"))
            for size, trips in sorted(set(zip(sizes.tolist(), passes.tolist()))):
                batch = whole.filter(pa.array((sizes == size) & (passes == trips)))
                offset = np.stack([np.frombuffer(u, np.float64) for u in batch.column("unit").to_pylist()])
                offset = offset - batch.column("mean").flatten().to_numpy().reshape(len(batch), size)
                for trip in range(trips):
                    code = (offset @ plane(size, trip) > 0) @ weight
                    yield pa.RecordBatch.from_arrays([
                        batch.column("label"), batch.column("size"), pa.array(np.full(len(batch), trip, np.int32)), pa.array(code),
                        batch.column("node"), batch.column("unit")], names=["label", "size", "trip", "code", "node", "unit"])

    return nodes.mapInArrow(run, "label string, size int, trip int, code long, node long, unit binary")


def _spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links of a block that join what all its links join."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near)):
        a, b = root(left[i]), root(right[j])
        if a != b:
            up[a] = b
            out.append((int(left[i]), int(right[j])))
    return out


def _window_rows(ordered: DataFrame) -> DataFrame:
    """a, b: verified links within windows of each sorted partition; spanning ones of each block."""
    def links(before: list, block: list) -> list[tuple[int, int]]:
        new = np.stack([np.frombuffer(r[1], np.float64) for r in block])
        ids = np.array([r[0] for r in block])
        out = _spanning(np.triu(new @ new.T >= COSINE, 1), ids, ids)
        if before:
            old = np.stack([np.frombuffer(r[1], np.float64) for r in before])
            out += _spanning(old @ new.T >= COSINE, np.array([r[0] for r in before]), ids)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before, block, out = None, [], [], []
        for batch in batches:
            for label, size, trip, node, unit in zip(*(batch.column(n).to_pylist() for n in ("label", "size", "trip", "node", "unit"))):
                if (label, size, trip) != key:
                    if block:
                        out += links(before, block)
                    key, before, block = (label, size, trip), [], []
                block.append((node, unit))
                if len(block) == BLOCK:
                    out += links(before, block)
                    before, block = block, []
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
            out = []
        if block:
            out = links(before, block)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def _count_rows(blocks: DataFrame) -> DataFrame:
    """node, linked: vectors linked with each node in one pair of blocks of a component."""
    def counted(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        side = np.array([r[0] for r in rows])
        ids, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        unit = np.stack([np.frombuffer(r[3], np.float64) for r in rows])
        left, right = (np.arange(len(rows)),) * 2 if (side == 0).all() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        near = unit[left] @ unit[right].T >= COSINE
        if left is right:
            np.fill_diagonal(near, False)
            return ids, near @ weight
        return np.r_[ids[left], ids[right]], np.r_[near @ weight[right], weight[left] @ near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for *block, side, node, copies, unit in zip(*(batch.column(n).to_pylist() for n in (
                    "component", "low", "high", "side", "node", "copies", "unit"))):
                if block != key and rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in counted(rows)], names=["node", "linked"])
                    rows = []
                key = block
                rows.append((side, node, copies, unit))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in counted(rows)], names=["node", "linked"])

    return blocks.mapInArrow(run, "node long, linked long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors of equal labels (and lengths) with cosine >= COSINE in double precision are linked. Null
    labels, null, empty or zero vectors and those with null or non-finite parts link with nothing.
    component_id is the smallest vec_id reachable. Rows whose vectors point the same way exactly are one
    node and linked with each other; a repeated vec_id gives repeated rows. Rows without vec_id are left out
    of minima and counted as links.

    Each pass orders the vectors of a label by BITS concatenated sign hashes of their offsets to the label's
    mean and compares windows of two blocks; larger and denser labels take more passes, so that a pair at
    COSINE is missed with about MISSED, up to MOST_PASSES. Only links that join a block are kept. Range partitions cut a label's order, so a label with a
    third of all rows takes many tasks. Once passes are united, links are counted inside each component
    by pairs of blocks: exact whatever its size, without a row per pair.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"),
                           F.col(label).cast("string").alias("label"))
    units = materialize(_pass_rows(given.filter("label is not null")), "units")
    nodes = materialize(units.groupBy("label", "unit").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
                        .filter("node is not null"), "nodes")
    order = ["label", "size", "trip", "code", "node"]
    sized = nodes.withColumn("size", (F.octet_length("unit") / 8).cast("int"))
    sized = sized.join(materialize(_label_means(nodes), "means"), ["label", "size"])
    ordered = _hash_rows(sized).repartitionByRange(tasks(spark), *order).sortWithinPartitions(*order)
    links = materialize(_window_rows(ordered).distinct(), "links")
    reached = components(links, "a", "b", "node", "component")

    sizes = reached.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    key = ["component", "low", "high"]
    rows = (reached.join(sizes, "component").join(nodes.drop("label"), "node").withColumn("block", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                    side.alias("side"), "node", "copies", "unit"))
    counts = _count_rows(rows.repartition(tasks(spark), *key).sortWithinPartitions(*key, "node"))
    linked = counts.groupBy("node").agg(F.sum("linked").alias("linked"))

    mine = (nodes.join(linked, "node", "left").join(reached, "node", "left")
            .select("label", "unit", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"),
                    F.coalesce("component", "node").alias("reached")))
    found = units.join(mine, ["label", "unit"]).select("vec_id", "links", "reached")
    # what has no unit vector stays alone
    usable = (F.col("label").isNotNull() & (F.size("embedding") > 0)
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    alone = given.filter(~F.coalesce(usable, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("reached"))
    return found.unionByName(alone).select(
        "vec_id", F.col("links").alias("n_links"), F.col("reached").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("reached"), F.lit(True)).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings within their labels."""
    return near_duplicates(table(spark, folder, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), c AS (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN c ON c.vec_id = v.vec_id"""
