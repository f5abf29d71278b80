"""Prefix trie of conversations by Patricia construction.

Conversations become byte strings, one element of 20 bytes a turn (a digest of role and text, and the text's length),
and are sorted by them over ranges. A task reads its range in order and keeps only the branch, end and leaf points of
the path it is on, with compressed edges; a point that it leaves is complete, its counts are added to the point above,
and the unary nodes of its edge are written by suffix sums along the edge.

A range sees the whole subtree of every node but those on the paths of its first and its last conversation, its spine.
Spine nodes are written as parts, at most two paths a range, and put together afterwards: counts add up by node; leaves
and savings, which need the whole counts, are suffix sums along each path, each node counted on one path only. So a
first turn that all conversations share is spread over all ranges, and nothing is gathered by it.

A conversation is a row (20 bytes a turn); no group of conversations is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, small
from larkspur.llm.ranks import CRC_TABLE_SQL, crc_sql

#: Bytes of a turn: a digest, and code points of its text.
DIGEST, TURN = 16, 20
NO_ENDS = sha256().hexdigest()


def element(role: Column, text: Column) -> Column:
    """A turn's bytes. Nulls count as empty texts; the role's length keeps role and text apart."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.concat(F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))), F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seq): each conversation's turns in order as bytes. Null turns come first, and turns that tie are in the
    order of their bytes. Rows without a conv_id are of no conversation and are left out."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), element(F.col(role_col), F.col(text_col)).alias("e")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    # Bytes have no join of their own, so they are joined as hex digits.
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda t: F.hex(t["e"])), "")).alias("seq"))


def rebuilt(convs: DataFrame, family: int = 100, most: int = 6) -> DataFrame:
    """Conversations c with their first h = crc32(c) % most turns replaced by those of conversation c - c % family."""
    heads = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(seq, 1, {TURN * (most - 1)})").alias("head"))
    own = convs.select("conv_id", "seq", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h"))
    seq = F.expr(f"concat(coalesce(substring(head, 1, {TURN} * h), X''), substring(seq, {TURN} * h + 1))")
    return own.join(heads, "base", "left").select("conv_id", seq.alias("seq"))


@dataclass
class Point:
    """A branch, end or leaf point of the open path. n and least are of all members below; leaves and saved of all nodes
    below that are not of the spine; waiting are the tops of edges below, until this point's least member is known."""

    depth: int
    n: int = 0
    least: int = 1 << 63
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ids: list = field(default_factory=list)
    waiting: list = field(default_factory=list)


def shared(a: bytes, b: bytes) -> int:
    """Turns that two conversations have in common at their start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[TURN * low : TURN * mid] == b[TURN * low : TURN * mid] else (low, mid - 1)
    return low


def key_of(seq: bytes, depth: int) -> bytes:
    return blake2b(seq[: TURN * depth], digest_size=DIGEST).digest()


def size_of(seq: bytes, depth: int) -> int:
    """Code points of the turn at a depth; the root has none."""
    return int.from_bytes(seq[TURN * depth - 4 : TURN * depth], "big") if depth else 0


#: Columns of a node as it is written, and of a spine node's part.
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
FOUND = NODE + ", parent_key binary, path string, key binary, size long, ids string"


class Range:
    """Builds the trie of one sorted range of (seq, conv_id); rows for FOUND gather in `out`."""

    def __init__(self, name: str):
        self.name, self.out = name, []
        self.path = [Point(0)]
        self.first = self.seq = b""
        self.left = -1  # depth down to which the open path is that of the first conversation; -1: none yet

    def add(self, seq: bytes, conv: int) -> None:
        if self.left < 0:
            self.first, self.left, common = seq, len(seq) // TURN, 0
        else:
            common = shared(self.seq, seq)
            self._leave(common)
            self.left = min(self.left, common)
        if self.path[-1].depth < len(seq) // TURN:
            self.path.append(Point(len(seq) // TURN))
        self.seq = seq
        end = self.path[-1]
        end.n, end.least = end.n + 1, min(end.least, conv)
        end.ids.append(str(conv))

    def _leave(self, depth: int) -> None:
        """Closes all points below a depth, and makes one there if the path had none."""
        while self.path[-1].depth > depth:
            done = self.path.pop()
            if self.path[-1].depth < depth:
                self.path.append(Point(depth))
            above = self.path[-1]
            if done.depth <= self.left:
                self._spine(done, above.depth, "first")
            else:
                self._edge(done, above)
            above.n, above.least = above.n + done.n, min(above.least, done.least)

    def _edge(self, done: Point, above: Point) -> None:
        """Writes a complete point and the unary nodes of its edge, from the point up."""
        saved, leaves = done.saved, done.leaves or 1
        ends = sha256(",".join(done.ids).encode()).hexdigest()
        self._settle(done, done.least)
        for depth in range(done.depth, above.depth, -1):
            saved += (done.n - 1) * size_of(self.seq, depth)
            own = depth == done.depth
            row = [done.least, depth, done.least, done.n, done.children if own else 1, leaves, saved, ends if own else NO_ENDS, *[None] * 5]
            if depth > above.depth + 1:
                self.out.append(row)
            else:
                row[2] = None
                above.waiting.append(row)
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        if above.depth <= self.left:
            self._settle(above, None)

    def _settle(self, point: Point, least: int | None) -> None:
        """Writes the nodes that wait for their parent's least member; without it, with their parent's key."""
        key = None if least is not None or not point.waiting else key_of(self.seq, point.depth)
        for row in point.waiting:
            row[2], row[8] = least, key
            self.out.append(row)
        point.waiting = []

    def _spine(self, done: Point, above: int, path: str) -> None:
        """Writes a spine point and the unary nodes of its edge as parts; sums are those of this range alone."""
        self._settle(done, None)
        for depth in range(done.depth, above, -1):
            own = depth == done.depth
            direct = [done.children, done.leaves, done.saved] if own else [0, 0, 0]
            ids = ",".join(done.ids) if own and done.ids else None
            parent = key_of(self.seq, depth - 1) if depth else None
            self.out.append([done.least, depth, None, done.n, *direct, None, parent, f"{self.name} {path}", key_of(self.seq, depth), size_of(self.seq, depth), ids])

    def close(self) -> None:
        """The range ends: all that is open is spine, on the last conversation's path."""
        if self.left < 0:
            return
        # The first path's nodes that are on the last path too carry its suffix sums upwards, and add nothing.
        for depth in range(self.left + 1 if self.left * TURN < len(self.first) else 0):
            parent = key_of(self.first, depth - 1) if depth else None
            self.out.append([None, depth, None, 0, 0, 0, 0, None, parent, f"{self.name} first", key_of(self.first, depth), size_of(self.first, depth), None])
        while self.path:
            done = self.path.pop()
            self._spine(done, self.path[-1].depth if self.path else -1, "last")
            if self.path:
                self.path[-1].n, self.path[-1].least = self.path[-1].n + done.n, min(self.path[-1].least, done.least)


def _build(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    build = Range(str(task.partitionId() if task else 0))
    names = [c.split()[0] for c in FOUND.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in FOUND.split(", ")]

    def batch() -> pa.RecordBatch:
        rows, build.out = build.out, []
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for b in it:
        for seq, conv in zip(b.column("seq").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            build.add(seq, conv)
            if len(build.out) >= 20_000:
                yield batch()
        yield batch()
    build.close()
    yield batch()


def _joined_ids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of rows (key, ids) that come in order: one hash runs through a key's rows."""
    key, running, done = None, None, []
    for b in it:
        for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if k == key:
                running.update(b",")
            else:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, sha256()
            running.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["key", "ends_sha256"])
        done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def _spine(parts: DataFrame) -> DataFrame:
    """Spine nodes put together: NODE and the key. parts has at most two paths a range."""
    ids = parts.where("ids IS NOT NULL").select("key", "ids", F.substring_index("ids", ",", 1).cast("long").alias("first_id"))
    ids = ids.repartition("key").sortWithinPartitions("key", "first_id").select("key", "ids")
    ends = ids.mapInArrow(_joined_ids, "key binary, ends_sha256 string")
    nodes = parts.groupBy("key").agg(F.min("conv_id").alias("least"), F.sum("n_convs").alias("n"), F.sum("n_children").alias("inside"), F.first("parent_key").alias("parent"), F.min("path").alias("owner"))
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("on_spine"))
    nodes = nodes.join(below, "key", "left").withColumn("children", F.col("inside") + F.coalesce("on_spine", F.lit(0)))
    nodes = materialize(nodes.join(ends, "key", "left"), "spine")
    # Down each path, what hangs off a node here, and on the path that owns it what the node itself adds.
    met = parts.join(small(nodes.select("key", "n", "children", "owner")), "key")
    own = F.col("path") == F.col("owner")
    down = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    leaves = F.sum(F.col("n_leaves") + F.when(own & (F.col("children") == 0), 1).otherwise(0)).over(down)
    saved = F.sum(F.col("saved_tokens") + F.when(own, (F.col("n") - 1) * F.col("size")).otherwise(0)).over(down)
    sums = met.select("key", "depth", leaves.alias("leaves"), saved.alias("saved")).groupBy("key").agg(F.first("depth").alias("depth"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    whole = nodes.join(sums, "key")
    above = nodes.select(F.col("key").alias("parent"), F.col("least").alias("parent_conv_id"))
    whole = whole.join(above, "parent", "left")
    return materialize(
        whole.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "key"),
        "spine",
    )


def nodes(convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of convs (conv_id, seq), the root among them: NODE.

    conv_id is a node's smallest member, n_convs its members, ends_sha256 the SHA-256 of the ids that end there, joined
    by commas; n_leaves and saved_tokens are of its subtree, itself included. Ids are expected to differ; repeated rows
    are members as often as they occur. No conversations give no nodes, not even a root.
    """
    ranged = convs.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    found = materialize(ranged.mapInArrow(_build, FOUND), "nodes")
    spine = _spine(materialize(found.where("path IS NOT NULL"), "parts"))
    columns = [c.split()[0] for c in NODE.split(", ")]
    inside = found.where("path IS NULL AND parent_key IS NULL").select(*columns)
    tops = found.where("path IS NULL AND parent_key IS NOT NULL").drop("parent_conv_id")
    known = small(spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    return inside.unionByName(tops.join(known, "parent_key").select(*columns)).unionByName(spine.select(*columns))


#: The same nodes in DuckDB SQL, over conversations: a row for each prefix, grouped by a chain of digests.
SQL = f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE_SQL}),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
again AS (
  SELECT c.conv_id, t.role, t.text, t.i AS place FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL
  SELECT c.conv_id, t.role, t.text, t.i FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h
), numbered AS (SELECT conv_id, sha256(length(role) || ':' || role || text) AS e, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM again),
prefixes AS (
  SELECT conv_id, depth, string_agg(e, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k, string_agg(e, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, size FROM numbered
  UNION ALL
  SELECT conv_id, 0, '', NULL, 0 FROM convs
), members AS (
  SELECT conv_id, depth, sha256(k) AS k, CASE WHEN depth > 0 THEN sha256(coalesce(p, '')) END AS p, size, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixes
), nodes AS (
  SELECT k, any_value(p) AS p, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM members GROUP BY k
), below AS (SELECT p AS k, count(*) AS children FROM nodes WHERE p IS NOT NULL GROUP BY p),
whole AS (SELECT n.*, coalesce(b.children, 0) AS children FROM nodes n LEFT JOIN below b USING (k)),
up(node, k, leaf, saved) AS (
  SELECT k, p, CAST(children = 0 AS INTEGER), (n - 1) * size FROM whole
  UNION ALL
  SELECT w.k, w.p, u.leaf, u.saved FROM up u JOIN whole w ON w.k = u.k
), sums AS (SELECT node AS k, sum(leaf) AS leaves, sum(saved) AS saved FROM up GROUP BY node)
SELECT w.conv_id, w.depth, a.conv_id AS parent_conv_id, w.n AS n_convs, w.children AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(w.ids) AS ends_sha256
FROM whole w JOIN sums s USING (k) LEFT JOIN whole a ON a.k = w.p"""
