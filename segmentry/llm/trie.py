"""Conversation prefix trie: union-find over sorted-neighbour common prefixes, forests merged across partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.common import bound_batches, table, tasks
from segmentry.session import materialize

#: Bytes of a turn in a sequence: a digest of its role and text, then the text's UTF-8 size.
DIGEST, SIZE = 16, 4
WIDTH = DIGEST + SIZE
#: Ids whose decimals are joined in one row before they meet those of the whole group.
PACKED = 20_000
#: Neighbouring forests that one task merges.
MERGED = 64

_FIELDS = [("forest", pa.int32()), ("open", pa.bool_()), ("first", pa.bool_()), ("last", pa.bool_()), ("key", pa.binary()),
           ("parent_key", pa.binary()), ("depth", pa.int64()), ("size", pa.int64()), ("conv_id", pa.int64()),
           ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
           ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = ("forest int, open boolean, first boolean, last boolean, key binary, parent_key binary, depth long, size long, conv_id long, "
        "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# --- sequences ------------------------------------------------------------------------------

def turn_pieces(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, piece: each turn as WIDTH bytes, equal for equal role and text; null ones are empty.

    Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * SIZE, "0")
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.concat(digest, size)).alias("piece"))


def ordered_pieces(turns: DataFrame, *keys: str) -> DataFrame:
    """One row per conversation: its pieces in order of (turn, digest), null turns first."""
    return turns.groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "piece"))), lambda t: t["piece"]).alias("pieces"))


# --- forests --------------------------------------------------------------------------------

@dataclass
class Node:
    """A node: depth, size of its last text, members, least member; kids, leaves and saved of closed children."""
    depth: int
    size: int
    conv_id: int
    n_convs: int
    key: bytes | None = None
    parent_key: bytes | None = None
    parent: Node | None = None
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    first: bool = False
    last: bool = False

    def close(self) -> None:
        """All children are known: count the node itself, and hand the sums to the parent."""
        self.leaves = self.leaves if self.kids else 1
        self.saved += (self.n_convs - 1) * self.size
        if self.parent:
            self.parent.kids += 1
            self.parent.leaves += self.leaves
            self.parent.saved += self.saved

    def row(self, forest: int) -> tuple:
        """What is stored: a closed node names its parent, by key if that is open still."""
        is_open, parent = self.first or self.last, self.parent
        unknown = parent is not None and (parent.first or parent.last)
        return (forest, is_open, self.first, self.last, self.key, self.parent_key if is_open or unknown else None, self.depth,
                self.size, self.conv_id, parent.conv_id if parent and not unknown else None, self.n_convs, self.kids,
                self.leaves, self.saved, self.ends)


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))) // WIDTH


def prefix_keys(sequence: bytes) -> list[bytes]:
    """Keys of the first 0, 1, ... turns."""
    state, out = hashlib.blake2b(digest_size=16), []
    for d in range(0, len(sequence) + 1, WIDTH):
        out.append(state.digest())
        state.update(sequence[d:d + WIDTH])
    return out


def branching_nodes(sequences: list[bytes]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(depth, parent, first sequence, last sequence) of the nodes where sorted distinct sequences end or branch.

    Union-find over the edges between neighbours by falling common prefix, equal ones from the left: every
    merge makes a node above both components, unless the left one's top has that depth already, as its end or
    by the merge before. Node i < len(sequences) is the end of sequence i; the root has no parent.
    """
    m = len(sequences)
    lcp = np.array([common_turns(a, b) for a, b in zip(sequences, sequences[1:])], np.int64)
    depth = [len(s) // WIDTH for s in sequences]
    parent, first, last, above, top = [-1] * m, list(range(m)), list(range(m)), list(range(m)), list(range(m))

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def node(d: int, a: int) -> int:
        depth.append(d)
        parent.append(-1)
        first.append(a)
        last.append(a)
        return len(depth) - 1

    for i in np.argsort(-lcp, kind="stable").tolist():
        a, b, d = find(i), find(i + 1), int(lcp[i])
        left, right = top[a], top[b]
        if depth[left] > d:
            top[a] = node(d, first[left])
            parent[left] = top[a]
        parent[right], last[top[a]] = top[a], last[right]
        above[b] = a
    whole = top[find(0)]
    if depth[whole]:
        parent[whole] = node(0, 0)
        last[parent[whole]] = m - 1
    return depth, parent, first, last


def partition_nodes(held: list[tuple[bytes, int, int, str]]) -> list[Node]:
    """All nodes of one partition's sorted distinct (sequence, conversations, least conversation, digest of ids).

    Nodes on the way to the first or to the last sequence may go on in the partitions beside: they stay open.
    The others are closed.
    """
    if not held:
        return []
    depth, parent, first, last = branching_nodes([h[0] for h in held])
    spines = {0: prefix_keys(held[0][0]), len(held) - 1: prefix_keys(held[-1][0])}
    order = sorted(range(len(depth)), key=lambda v: depth[v])
    convs = [h[1] for h in held] + [0] * (len(depth) - len(held))
    least = [h[2] for h in held] + [2**63 - 1] * (len(depth) - len(held))
    for v in reversed(order):
        if parent[v] >= 0:
            convs[parent[v]] += convs[v]
            least[parent[v]] = min(least[parent[v]], least[v])
    out: list[Node] = []
    lowest: list[Node | None] = [None] * len(depth)
    for v in order:  # parents first; a chain of single children has one node a turn
        sequence, above = held[first[v]][0], lowest[parent[v]] if parent[v] >= 0 else None
        at_start, at_end = first[v] == 0, last[v] == len(held) - 1
        keys = spines[0] if at_start else spines[len(held) - 1] if at_end else None
        for d in range(above.depth + 1 if above else 0, depth[v] + 1):
            size = int.from_bytes(sequence[d * WIDTH - SIZE:d * WIDTH], "big") if d else 0
            above = Node(d, size, least[v], convs[v], keys and keys[d], None, above, first=at_start, last=at_end)
            if above.parent and above.parent.key:
                above.parent_key = above.parent.key
            out.append(above)
        lowest[v] = above
    for v, h in enumerate(held):
        lowest[v].ends = h[3]
    for node in reversed(out):  # deepest of every branch first
        if not (node.first or node.last):
            node.close()
    return out


def merged_nodes(rows: list[dict], final: bool) -> list[Node]:
    """The open nodes of neighbouring forests, those of equal key as one; only the outermost ways stay open, none at the end."""
    forests = sorted({r["forest"] for r in rows})
    nodes: dict[bytes, Node] = {}
    for r in rows:
        node = nodes.setdefault(r["key"], Node(r["depth"], r["size"], r["conv_id"], 0, r["key"], r["parent_key"]))
        node.conv_id = min(node.conv_id, r["conv_id"])
        node.n_convs += r["n_convs"]
        node.kids += r["n_children"]
        node.leaves += r["n_leaves"]
        node.saved += r["saved_tokens"]
        node.ends = node.ends or r["ends_sha256"]
        node.first |= not final and r["first"] and r["forest"] == forests[0]
        node.last |= not final and r["last"] and r["forest"] == forests[-1]
    for node in nodes.values():
        node.parent = nodes.get(node.parent_key) if node.depth else None
    out = sorted(nodes.values(), key=lambda n: -n.depth)
    for node in out:
        if not (node.first or node.last):
            node.close()
    return out


def _batch(nodes: list[Node], forest: int) -> pa.RecordBatch:
    columns = zip(*(n.row(forest) for n in nodes)) if nodes else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], schema=_SCHEMA)


def _packed(rows: DataFrame) -> DataFrame:
    """sequence, least, n, ids: up to PACKED conversations of one sequence, their decimals joined; rows arrive sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(sequence: bytes, ids: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([sequence], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([",".join(map(str, ids))], pa.string())], names=["sequence", "least", "n", "ids"])

        now, ids, out = None, [], []
        for batch in batches:
            for sequence, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (sequence != now or len(ids) == PACKED):
                    out.append(pack(now, ids))
                    ids = []
                now = sequence
                ids.append(conv_id)
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if ids:
            yield pack(now, ids)

    return rows.mapInArrow(run, "sequence binary, least long, n long, ids string")


def _forests(packed: DataFrame) -> DataFrame:
    """Nodes of every range partition; rows arrive sorted by sequence and least id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int, int, str]] = []
        now, n, least, state = None, 0, 0, None
        for batch in batches:
            for sequence, low, count, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if sequence != now:
                    if state:
                        held.append((now, n, least, state.hexdigest()))
                    now, n, least, state = sequence, 0, low, hashlib.sha256()
                state.update((("," if n else "") + ids).encode())
                n += count
        if state:
            held.append((now, n, least, state.hexdigest()))
        nodes, forest = partition_nodes(held), TaskContext.get().partitionId()
        for i in range(0, len(nodes), 10_000):
            yield _batch(nodes[i:i + 10_000], forest)

    return packed.mapInArrow(run, _DDL)


def _merged(ways: DataFrame, final: bool) -> DataFrame:
    """Nodes of MERGED neighbouring forests at a time."""
    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        return pa.Table.from_batches([_batch(merged_nodes(rows, final), rows[0]["forest"] // MERGED)], _SCHEMA)

    group = F.lit(0) if final else F.expr(f"forest div {MERGED}")
    return ways.withColumn("__group", group).groupBy("__group").applyInArrow(
        lambda group: merge(group.drop_columns("__group")), _DDL)


def prefix_trie(rows: DataFrame) -> DataFrame:
    """All nodes of the trie of (conv_id, sequence): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    `sequence` is WIDTH bytes a turn. Equal sequences meet first, their ids packed, so that copies of one
    conversation are few rows. Distinct sequences are dealt by range; each partition makes a forest by
    union-find, closes what lies inside and hands on the two outer ways, a row per turn. Neighbouring
    forests are merged MERGED at a time until one is left, so no task sees more than that many ways.
    No rows give no nodes.
    """
    bound_batches(rows.sparkSession)
    n = tasks(rows.sparkSession)
    rows = rows.select("sequence", "conv_id").repartitionByRange(n, "sequence", "conv_id").sortWithinPartitions("sequence", "conv_id")
    packed = materialize(_packed(rows), "packed")
    forests = materialize(_forests(packed.repartitionByRange(n, "sequence").sortWithinPartitions("sequence", "least")), "forests")
    closed, ways = [forests.filter("not open")], forests.filter("open")
    while True:
        n = -(-n // MERGED)
        final = n == 1

        done = materialize(_merged(ways, final), "merged")
        closed.append(done.filter("not open"))
        ways = done.filter("open")
        if final:
            break
    nodes, opened = closed[0], closed[1]
    for more in closed[1:]:
        nodes = nodes.unionByName(more)
    for more in closed[2:]:
        opened = opened.unionByName(more)
    parents = opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__parent"))
    known = nodes.filter("parent_key is null").select(*_COLUMNS)
    unknown = nodes.filter("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("__parent"))
    return known.unionByName(unknown.select(*_COLUMNS)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, sequence: each conversation c after the first h turns of conversation c - c % 5, h = crc32(c) % 9.

    Turns are placed once, by the conversation that lends: both sides of the join have that placement.
    """
    base = F.col("conv_id") - F.col("conv_id") % 5
    turns = turn_pieces(conversations).withColumn("base", base).repartition("base")
    own = ordered_pieces(turns, "base", "conv_id")
    lent = ordered_pieces(turns.filter("conv_id = base"), "base").withColumnRenamed("pieces", "lent")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9)).cast("int")
    none = F.array().cast("array<binary>")
    pieces = F.concat(F.coalesce(F.slice("lent", F.lit(1), h), none), F.slice("pieces", h + 1, F.greatest(F.size("pieces"), F.lit(1))))
    return own.join(lent, "base", "left").select("conv_id", F.unhex(F.array_join(F.transform(pieces, F.hex), "")).alias("sequence"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(materialize(rebuilt(table(spark, folder, "conversations")), "rebuilt"))


# crc32 bit by bit: a byte is taken in, then eight steps (-1) shift the register
_CRC = """xor(list_reduce(list_concat([4294967295], flatten(
    [[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split({0}, '')])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
OP11_SQL = f"""
WITH given AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
pieces AS (
  SELECT conv_id, turn, strlen(text) AS size, md5(length(role) || ':' || role || text) || printf('%08X', strlen(text)) AS piece FROM given),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, piece) AS rn FROM pieces),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM given)),
parts AS (
  SELECT i.conv_id, 0 AS part, n.rn, n.size, n.piece FROM ids i JOIN numbered n ON n.conv_id = i.base AND n.rn <= i.h
  UNION ALL SELECT i.conv_id, 1, n.rn, n.size, n.piece FROM ids i JOIN numbered n ON n.conv_id = i.conv_id AND n.rn > i.h),
placed AS (
  SELECT conv_id, size, piece, row_number() OVER (PARTITION BY conv_id ORDER BY part, rn) AS depth FROM parts),
prefixes AS (
  SELECT conv_id, depth, size, md5(string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
linked AS (
  SELECT *, lag(key) OVER w AS parent, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS ends
  FROM prefixes WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent,
    (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY key, depth),
kids AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT p.key, sum(n.saved) AS saved_tokens, count(*) FILTER (k.n IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN kids k ON k.key = n.key JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN kids k ON k.key = n.key LEFT JOIN nodes u ON u.key = n.parent"""
