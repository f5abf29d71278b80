"""Merkle manifest of a dataset: every row's leaf, its group's subroot, the root, and each leaf's authentication path.

A group's leaves in order are the lowest level; while a level has several nodes, every three consecutive ones (the last
run may have fewer, even one) become their hash. Groups' subroots in order make the root in the same way.

Leaves are cut into aligned blocks of 729. In a task, a block is traversed fractally: a stack of existing subtrees of
two levels each holds the current leaf's path, and beside each the next subtree of its level, the desired one, takes one
leaf for each path that is given out, so it is ready when the traversal enters it. That holds some tens of digests a
level, whatever the block's size. Blocks' roots are leaves of the same kind one tier up (one in 729), traversed in the
same way until a group has one block; paths of the tiers above are joined to the blocks and appended.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from larkspur.llm.common import materialize, small
from larkspur.llm.ranks import CRC_TABLE_SQL, crc_sql, positions, same_keys

#: Nodes of a run, levels of a subtree of the traversal, and levels of a block.
ARITY, SUBTREE, BLOCK = 3, 2, 6
SPAN = ARITY**BLOCK


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above n leaves until one node is left."""
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


class Subtree:
    """The nodes of levels low to top - 1 below one node of level top, made of leaves that come one at a time.

    Below low only unfinished runs are held: at most two digests a level.
    """

    def __init__(self, low: int, top: int):
        self.low, self.top, self.root = low, top, ""
        self.runs: list[list[str]] = [[] for _ in range(top)]
        self.nodes: list[list[str]] = [[] for _ in range(top - low)]

    def _put(self, level: int, node: str) -> None:
        if level == self.top:
            self.root = node
            return
        if level >= self.low:
            self.nodes[level - self.low].append(node)
        self.runs[level].append(node)

    def add(self, leaf: str) -> None:
        self._put(0, leaf)
        for level in range(self.top):
            if len(self.runs[level]) < ARITY:
                return
            self._up(level)

    def _up(self, level: int) -> None:
        run = self.runs[level]
        self._put(level + 1, digest("".join(run)))
        run.clear()

    def close(self) -> Subtree:
        """No leaf is left: runs end as they are."""
        for level in range(self.top):
            if self.runs[level]:
                self._up(level)
        return self


def grown(leaves: list[str], low: int, top: int) -> Subtree:
    tree = Subtree(low, top)
    for leaf in leaves[: ARITY**top]:
        tree.add(leaf)
    return tree.close()


def block_root(leaves: list[str], levels: int) -> str:
    return grown(leaves, levels, levels).root if levels else leaves[0]


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """Each leaf's path through `levels` levels: for each level the siblings left of it and right of it, concatenated."""
    steps = [(low, min(low + SUBTREE, levels)) for low in range(0, levels, SUBTREE)]
    existing = [grown(leaves, low, top) for low, top in steps]
    desired = [Subtree(low, top) for low, top in steps]
    for i in range(len(leaves)):
        for k, (low, top) in enumerate(steps[:-1]):
            if i and i % ARITY**top == 0:
                existing[k], desired[k] = desired[k].close(), Subtree(low, top)
        path = []
        for level in range(levels):
            tree = existing[level // SUBTREE]
            at = i // ARITY**level % ARITY ** (tree.top - level)
            run, nodes = at - at % ARITY, tree.nodes[level - tree.low]
            path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + ARITY])))
        yield path
        for k, (_, top) in enumerate(steps[:-1]):
            ahead = i + ARITY**top
            if ahead < len(leaves):
                desired[k].add(leaves[ahead])


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """What leaf and the siblings of a path give at its top."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def _spelled(path: list[tuple[str, str]]) -> list[str]:
    return [f"{left}|{right}" for left, right in path]


def _read(path: list[str] | None) -> list[tuple[str, str]]:
    return [tuple(x.split("|")) for x in path or []]


def _levels(n: int) -> int:
    """Levels inside a block of a group of n leaves."""
    return BLOCK if n > SPAN else height(n)


def leaf(fields: list[Column]) -> Column:
    """A row's leaf, 32 bytes: SHA-256 of its fields, each `-` if null, else its UTF-8 byte count, a colon and itself."""
    spelled = [F.coalesce(F.concat(F.octet_length(f.cast("string")), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*spelled), 256))


def _blocks(nodes: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group.., n, block, rows): rows are the block's nodes in order, at most SPAN."""
    block = F.floor(F.col("pos") / SPAN).cast("long").alias("block")
    rows = F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("rows")
    return materialize(nodes.groupBy(*group, "n", block).agg(rows), "blocks")


def _roots(blocks: DataFrame, group: list[str]) -> DataFrame:
    """The blocks' roots as the next tier's nodes: (group.., pos, n, digest)."""

    def roots(it):
        for b in it:
            found = [bytes.fromhex(block_root([x["digest"].hex() for x in rows], _levels(n))) for rows, n in zip(b.column("rows").to_pylist(), b.column("n").to_pylist(), strict=True)]
            tier = pa.array([-(-n // SPAN) for n in b.column("n").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(g) for g in group], b.column("block"), tier, pa.array(found, pa.binary())], names=[*group, "pos", "n", "digest"])

    schema = blocks.select(*group, F.col("block").alias("pos"), "n").schema.add("digest", "binary")
    return materialize(blocks.select(*group, "n", "block", "rows").mapInArrow(roots, schema), "roots")


def _climb(nodes: DataFrame, group: list[str]) -> DataFrame:
    """(group.., pos, path, root) of a tier's nodes, up to the group's root."""
    blocks = _blocks(nodes, group, ["digest"])
    if blocks.where(F.col("n") > SPAN).isEmpty():
        above = blocks.withColumns({"above": F.array().cast("array<string>"), "root": F.lit(None).cast("string")})
    else:
        up = _climb(_roots(blocks, group), group).select(*group, F.col("pos").alias("block"), F.col("path").alias("above"), "root")
        above = blocks.join(small(up), same_keys(blocks, up, [*group, "block"])).select(blocks["*"], "above", "root")

    def paths(it):
        for b in it:
            own = [b.column(g).to_pylist() for g in group]
            out: list[list] = [[] for _ in range(len(group) + 3)]
            for i, (n, rows, rest, root) in enumerate(zip(*[b.column(c).to_pylist() for c in ("n", "rows", "above", "root")], strict=True)):
                leaves, rest = [x["digest"].hex() for x in rows], _read(rest)
                for x, node, path in zip(rows, leaves, traverse(leaves, _levels(n)), strict=True):
                    whole = path + rest
                    for column, v in zip(out, [*[g[i] for g in own], x["pos"], _spelled(whole), root or fold(node, whole)], strict=True):
                        column.append(v)
            types = [*[b.schema.field(g).type for g in group], pa.int64(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names=[*group, "pos", "path", "root"])

    schema = nodes.select(*group, "pos").schema.add("path", ArrayType(StringType())).add("root", "string")
    return materialize(above.select(*group, "n", "rows", "above", "root").mapInArrow(paths, schema), "paths")


def manifest(docs: DataFrame, fields: list[str], group_col: str = "source", order_col: str = "doc_id", shown: dict[str, Column] | None = None, with_path: bool = False) -> DataFrame:
    """A row for each row of docs: order_col, `leaf`, `subroot`, `root` and `proof_sha256` (of the path's siblings, from
    the leaf's level up, left to right), `folded_root` and `verified` (it equals root). with_path adds `path`: for each
    level the siblings left of the node, a bar, and those right of it.

    `shown` gives fields as they are presented for verification, where that isn't what the manifest was made of:
    folded_root is computed from the leaf of those. Groups and rows ascend, null first; rows that tie are in the order
    of their leaves, so repeated rows, each a leaf, have the same leaf and any order gives the same root. Null and empty
    texts differ. A single row is subroot and root itself, with an empty path. No rows give no rows. Other columns of
    docs may have any name.
    """
    presented = leaf([(shown or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(F.col(group_col).alias("group"), F.col(order_col).alias("key"), leaf([F.col(f) for f in fields]).alias("digest"), presented.alias("shown"))
    rows = rows.withColumn("shown", F.when(F.col("shown") != F.col("digest"), F.col("shown")))  # null: as it was
    group = ["group"]
    ranked = positions(materialize(rows, "leaves"), group, [F.col("key").asc(), F.col("digest").asc()], "leaves")
    blocks = _blocks(ranked, group, ["key", "digest", "shown"])
    up = _climb(_roots(blocks, group), group)
    subroots = materialize(up.where("pos = 0").select("group", F.unhex("root").alias("digest")), "subroots")
    tops = positions(subroots, [], [F.col("group").asc()], "subroots").withColumn("all", F.lit(0))
    # A subroot's path, found by its place among the groups.
    top = _climb(tops.select("all", "pos", "n", "digest"), ["all"])
    named = materialize(tops.select("group", "pos").join(top, "pos").select("group", F.col("path").alias("top"), F.col("root").alias("whole")), "tops")
    rest = up.join(small(named), up["group"].eqNullSafe(named["group"]))
    rest = materialize(rest.select(up["group"], F.col("pos").alias("block"), "path", "top", F.col("root").alias("subroot"), F.col("whole").alias("root")), "above")
    met = blocks.join(small(rest), same_keys(blocks, rest, ["group", "block"])).select("n", "rows", "path", "top", "subroot", "root")

    def emit(it):
        for b in it:
            for n, rows, path, top, subroot, root in zip(*[b.column(c).to_pylist() for c in ("n", "rows", "path", "top", "subroot", "root")], strict=True):
                leaves, rest = [x["digest"].hex() for x in rows], _read(path) + _read(top)
                proofs, folded, paths = [], [], []
                for x, own, inside in zip(rows, leaves, traverse(leaves, _levels(n)), strict=True):
                    whole = inside + rest
                    proofs.append(digest("".join(left + right for left, right in whole)))
                    folded.append(fold(own if x["shown"] is None else x["shown"].hex(), whole))
                    if with_path:
                        paths.append(_spelled(whole))
                out = {"key": [x["key"] for x in rows], "leaf": leaves, "subroot": [subroot] * len(rows), "root": [root] * len(rows), "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]}
                if with_path:
                    out["path"] = paths
                kinds = {"key": b.schema.field("rows").type.value_type.field("key").type, "verified": pa.bool_(), "path": pa.list_(pa.string())}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()], names=list(out))

    schema = ranked.select("key").schema
    for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        schema = schema.add(c, "string")
    schema = schema.add("verified", "boolean")
    found = met.mapInArrow(emit, schema.add("path", ArrayType(StringType())) if with_path else schema)
    return found.withColumnRenamed("key", order_col)


def _leaf_sql(text: str) -> str:
    spelled = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(spelled)})"


#: The same rows in DuckDB SQL, over documents. Levels are a recursion; each document then meets its run at each level.
SQL = f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE_SQL}),
leaves AS (
  SELECT doc_id, coalesce('1' || source, '0') AS g, {_leaf_sql("text")} AS leaf,
    CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS shown,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos
  FROM documents, crc_table
), low(g, lvl, pos, h) AS (
  SELECT g, 0, pos, leaf FROM leaves
  UNION ALL
  SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM low) WHERE c > 1 GROUP BY g, lvl, pos // 3
), subroots AS (SELECT g, max(lvl) AS top, arg_max(h, lvl) AS h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM low GROUP BY g),
high(lvl, pos, h) AS (
  SELECT 0, pos, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM high) WHERE c > 1 GROUP BY lvl, pos // 3
), steps AS (
  SELECT l.doc_id, l.g, l.pos, s.lvl, s.h, s.pos AS place, CAST(floor(l.pos / pow(3, s.lvl)) AS BIGINT) AS mine
  FROM leaves l JOIN low s ON s.g = l.g AND s.pos // 3 = CAST(floor(l.pos / pow(3, s.lvl + 1)) AS BIGINT) JOIN subroots t ON t.g = l.g AND s.lvl < t.top
  UNION ALL
  SELECT l.doc_id, l.g, l.pos, 1000 + s.lvl, s.h, s.pos, CAST(floor(t.pos / pow(3, s.lvl)) AS BIGINT)
  FROM leaves l JOIN subroots t ON t.g = l.g JOIN high s ON s.pos // 3 = CAST(floor(t.pos / pow(3, s.lvl + 1)) AS BIGINT) AND s.lvl < (SELECT max(lvl) FROM high)
), sides AS (
  SELECT g, pos, lvl, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place < mine), '') AS l, coalesce(string_agg(h, '' ORDER BY place) FILTER (WHERE place > mine), '') AS r FROM steps GROUP BY g, pos, lvl
), proofs AS (SELECT g, pos, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS path FROM sides GROUP BY g, pos),
whole AS (SELECT arg_max(h, lvl) AS root FROM high),
folded AS (
  SELECT l.doc_id, l.leaf, t.h AS subroot, w.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(l.shown, coalesce(p.path, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots t ON t.g = l.g CROSS JOIN whole w LEFT JOIN proofs p ON p.g = l.g AND p.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM folded"""
