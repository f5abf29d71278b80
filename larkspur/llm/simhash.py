"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint: the bitwise majority of the XXH64 of its word shingles. Two fingerprints
link when they differ in at most `radius` bits; linked documents form components.

Candidates come from a covering family: each bit position i is given a vector m(i) of radius+1 bits; for every
nonzero vector v of that length, the mask v keeps the positions with an odd number of common ones in m(i) and v.
`radius` differing positions span at most `radius` dimensions, so some v is orthogonal to all of their m(i): that
mask keeps none of them, and the pair has equal masked values in its table. No pair within the radius is missed.

A table's bucket holds distinct fingerprints only (copies are grouped before). Buckets are compared in blocks of at
most about `block` fingerprints, pairs of blocks going to separate rows, so no task ever holds a large bucket; a
block yields a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, small
from larkspur.llm.components import connected_components

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of UTF-8 text, repeats included.

    A-Z are lower-cased and words are separated by ASCII white space. Texts of fewer words than a shingle are one
    shingle; texts without words have none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    of = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    return np.fromiter((of(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Unsigned fingerprint of 64-bit hashes: a bit is set if over half of them have it. No hashes: 0."""
    n = len(h)
    ones = np.concatenate([np.bincount(column, minlength=256) @ _BYTE_BITS for column in h.astype("<u8").view(np.uint8).reshape(n, 8).T])
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit majority fingerprint of UTF-8 text; 0 where there are no words."""
    return majority(shingle_hashes(text, shingle_words, seed))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long. A null text counts as empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = [_signed(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, shingle_words, seed)) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(batches, "doc_id long, fp long")


def covering_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """The 2**(radius+1) - 1 masks of the family, as unsigned integers.

    Position i gets the vector m(i) = 1 + i mod (2**(radius+1) - 1), so all nonzero vectors are used about equally.
    """
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if (v & (1 + i % top)).bit_count() % 2) for v in range(1, top + 1)]


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Star edges (place, first place) of each group among n places; near(i, others) says which others link to i.

    Each place meets only places that no group has yet, so a bucket of near copies takes about n comparisons.
    """
    out, rest = [], np.arange(n)
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        ahead = [root]
        while ahead and len(rest):
            linked = near(ahead.pop(), rest)
            found, rest = rest[linked], rest[~linked]
            ahead += found.tolist()
            out += [(i, root) for i in found.tolist()]
    return out


def _star(near: np.ndarray) -> list[tuple[int, int]]:
    return _forest(len(near), lambda i, others: near[i, others])


def bucket_links(rows: DataFrame, near: Callable[[np.ndarray, int, np.ndarray], np.ndarray], block: int, value: str = "node") -> DataFrame:
    """Links (a, b) between nodes that share a bucket, from rows (key, size, node[, value]), size being the bucket's.

    A bucket of n nodes is cut into ceil(n / block) parts, and each pair of parts is compared apart, so no task holds
    a large bucket. near(values, i, others) says which others link to i; of those links a spanning forest is kept, so
    no group is written out as all its pairs. A value is binary, of one length for all.
    """
    parts = F.ceil(F.col("size") / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cell = rows.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    held = F.struct("node", F.col(value).alias("value")) if value != "node" else F.col("node")
    cells = cell.agg(F.collect_list(held).alias("held")).where(F.size("held") > 1)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for x in b.column("held"):
                struct = x.values
                nodes = (struct if value == "node" else struct.field("node")).to_numpy(zero_copy_only=False)
                values = nodes if value == "node" else np.frombuffer(b"".join(struct.field("value").to_pylist()), np.uint8).reshape(len(nodes), -1)
                out += [(int(nodes[i]), int(nodes[r])) for i, r in _forest(len(nodes), lambda i, others, v=values: near(v, i, others))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return cells.select("held").mapInArrow(batches, "a long, b long").distinct()


def buckets(keyed: DataFrame) -> DataFrame:
    """(key, size, node) for the buckets with company, from (key, node) rows without repeats. Buckets of the same nodes
    are one, as a pair of near copies shares many."""
    same = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    shared = keyed.groupBy("key").agg(F.count("*").alias("size"), *same).where("size > 1")
    once = materialize(shared.groupBy("size", "s0", "s1").agg(F.min("key").alias("key")).select("key", "size"), "shared")
    return keyed.join(small(once), "key").select("key", "size", "node")


def near_links(fps: DataFrame, radius: int = 3, block: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect exactly what pairs within the radius connect."""
    keys = F.explode(F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(covering_masks(radius))]))
    rows = buckets(fps.select(F.col("fp").alias("node"), keys.alias("key")))
    # Unsigned: the bits of a negative number are counted in its absolute value.
    return bucket_links(rows, lambda v, i, others: np.bitwise_count((v[i] ^ v[others]).view(np.uint64)) <= radius, block)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, radius: int = 3, block: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: component_id is the smallest doc_id reachable over links.

    Null or empty texts, and texts without words, have fingerprint 0 and link like any other. Repeated rows each keep
    a row. A null doc_id keeps its row and never names a component unless the component has no other id (then null).
    Other columns of docs are not read. An empty table gives no rows.
    """
    prints = materialize(with_fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    groups = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    # Fingerprints are mixed by a bijective hash before contraction, so that the order of ids is random.
    mixed = near_links(groups, radius, block).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    roots = connected_components(mixed)
    own = groups.withColumn("node", F.xxhash64("fp"))
    own = own.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    own = materialize(own, "roots")
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


#: The stage's similarity, and its min-wise signature: bands of so many rows each. Signatures only find candidates: at a
#: similarity of 0.8 a pair shares a band with probability 0.9999, and its estimate then falls below LEAST_ESTIMATE
#: (over four standard deviations) in one of some 30,000 cases.
SIMILARITY, BANDS, BAND_ROWS, LEAST_ESTIMATE = 0.8, 25, 5, 0.65
_MULTIPLIERS = (np.random.default_rng(1).integers(1, 1 << 63, BANDS * BAND_ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)


def signature(h: np.ndarray) -> np.ndarray:
    """Min-wise signature (uint32) of a set of shingle hashes; all ones for none."""
    out = np.full(len(_MULTIPLIERS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        part = (h[at : at + 512, None] * _MULTIPLIERS[None, :]) >> np.uint64(32)
        out = np.minimum(out, part.min(axis=0).astype(np.uint32))
    return out


def with_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, radius: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, copy, node, keys, places) for every row: a hash of the text, a hash of the set of shingles, the buckets
    of the fingerprint's covering masks and of the signature's bands, and a byte of each of the signature's places.
    Texts of the same shingles share a node."""
    masks = covering_masks(radius)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = xxhash.xxh64_intdigest
        for b in (whole.slice(at, 2000) for whole in it for at in range(0, whole.num_rows, 2000)):
            nodes, keys, places = [], [], []
            for t in b.column("text").cast(pa.binary()):
                h = shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else None, shingle_words, seed)
                fp = majority(h)
                h = np.unique(h)
                sig = signature(h)
                bands = sig.reshape(BANDS, BAND_ROWS)
                nodes.append(_signed(of(h.tobytes())))
                keys.append([*[_signed(of((fp & m).to_bytes(8, "little"), k)) for k, m in enumerate(masks)], *[_signed(of(x.tobytes(), len(masks) + k)) for k, x in enumerate(bands)]])
                places.append(sig.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.binary())], ["doc_id", "copy", "node", "keys", "places"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("copy", _copy("text"))
    return kept.mapInArrow(batches, "doc_id long, copy long, node long, keys array<long>, places binary")


def _copy(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _estimate(v: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Which signatures' estimated similarity to the i-th is LEAST_ESTIMATE or more; bytes agree by chance in 1 of 256."""
    return (v[others] == v[i]).mean(axis=1) >= LEAST_ESTIMATE + (1 - LEAST_ESTIMATE) / 256


def similar_links(nodes: DataFrame, block: int = 512) -> DataFrame:
    """Candidate links (a, b) between distinct nodes (node, keys, places) that share a bucket and whose signatures agree.

    Only nodes in a bucket with company carry their signature along.
    """
    rows = materialize(buckets(nodes.select("node", F.explode("keys").alias("key"))), "buckets")
    return bucket_links(rows.join(nodes.select("node", "places"), "node"), _estimate, block, "places")


def _alike(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have an exact Jaccard similarity of SIMILARITY or more, as a symmetric matrix."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[place] > 1  # what only one set holds is in no intersection
    owner, place = owner[common], (np.cumsum(times > 1) - 1)[place[common]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both, width = np.zeros((n, n), np.float32), 4096
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        lo, hi = np.searchsorted(place, [at, at + width])
        part = np.zeros((n, int(place[hi - 1]) - at + 1), np.float32)
        part[owner[lo:hi], place[lo:hi] - at] = 1
        both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both.astype(np.float64)
    near = both >= SIMILARITY * union - 1e-9
    np.fill_diagonal(near, True)
    return near


def verified_links(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, seed: int = 42, block: int = 256) -> DataFrame:
    """Links (a, b, whole) that connect exactly what pairs of an exact shingle similarity of SIMILARITY connect, within
    the groups (node, root, doc_id, copy) that candidate links made; doc_id and copy say which row has a node's text.

    All pairs of a group are compared on their shingle hashes, whatever their estimates. Each node's text goes to its
    group once; groups over `block` nodes are cut into parts, and pairs of parts are compared apart, as in bucket_links().
    Links of a group that is whole in one cell are stars: b is a's component.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    where = materialize(groups.join(small(materialize(sizes, "sizes")), "root").select("node", "root", "doc_id", "copy", F.ceil(F.col("size") / block).cast("int").alias("parts")), "groups")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), _copy(text_col).alias("_copy"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(small(where), (F.col("_copy") == F.col("copy")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "parts", "node", "text")

    def cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and node; a cell may go on in the next batch, and rows that are alike follow each other."""
        cell, nodes, held = None, [], []
        for b in it:
            out = []
            keys = zip(*[b.column(c).to_pylist() for c in ("root", "i", "j", "parts")], strict=True)
            for key, node, text in zip(keys, b.column("node").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                if key != cell:
                    out += linked(cell, nodes, held)
                    cell, nodes, held = key, [], []
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    held.append(np.unique(shingle_hashes(text.as_buffer().to_pybytes(), shingle_words, seed)))
            yield edges(out)
        yield edges(linked(cell, nodes, held))

    def linked(cell: tuple | None, nodes: list[int], held: list[np.ndarray]) -> list[tuple[int, int, bool]]:
        return [(nodes[i], nodes[r], cell[3] == 1) for i, r in _star(_alike(held))] if len(held) > 1 else []

    def edges(out: list[tuple[int, int, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "whole"])

    found = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(cells, "a long, b long, whole boolean")
    return materialize(found, "verified")


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, radius: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's (doc_id, copy, node); every node's (node, least, rows), least being its first row by id, then text; and
    (node, root) of nodes that link to another."""
    prints = materialize(with_signatures(docs, id_col, text_col, shingle_words, radius), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("least")
    nodes = materialize(prints.groupBy("node").agg(first, F.count("*").alias("rows"), F.first("keys").alias("keys"), F.first("places").alias("places")), "nodes")
    candidates = connected_components(similar_links(nodes))
    groups = candidates.join(nodes.select("node", "least.doc_id", "least.copy"), "node")
    links = verified_links(docs, groups, id_col, text_col, shingle_words)
    whole = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = materialize(whole.unionByName(connected_components(links.where("NOT whole"))), "roots")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    return prints.select("doc_id", "copy", "node"), nodes.select("node", "least", "rows"), materialize(roots, "roots")


def similar_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, radius: int = 3) -> DataFrame:
    """(doc_id, component_id) for every row, as near_duplicates(), with links at a shingle similarity of 0.8 or more.

    A radius of 3 bits holds only pairs of higher similarity (at 0.8 about ten bits differ), and no covering family of
    usable size reaches that far. So candidates share a bucket of the covering tables or a band of a min-wise signature;
    the pairs of a group of candidates link if their exact similarity is 0.8 or more.
    """
    prints, nodes, roots = _similar(docs, id_col, text_col, shingle_words, radius)
    own = materialize(nodes.select("node", "least.doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), "named")
    named = own.join(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "component_id")
    return prints.join(named, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similar_duplicates(): that with the smallest id (rows without an id come last), of
    those the one with the smallest hash of its text, and of rows alike in both just one.

    Two texts under one id are different rows, and each stays if it is its component's first. Only ids and hashes move:
    a table of the rows to drop is joined to docs, which is no shuffle of texts unless very many are dropped.
    """
    prints, nodes, roots = _similar(docs, id_col, text_col, 5, 3)
    linked = nodes.join(roots, "node", "left").where("root IS NOT NULL OR rows > 1").select("node", "least", F.coalesce("root", "node").alias("root"))
    linked = materialize(linked, "linked")
    winner = materialize(linked.groupBy("root").agg(F.min("least").alias("winner")), "winners")
    named = materialize(linked.select("node", "root").join(small(winner), "root").select("node", "winner"), "named")
    rows = prints.join(small(named), "node").groupBy("doc_id", "copy").agg(F.count("*").alias("times"), F.first("winner").alias("winner"))
    wins = F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("copy") == F.col("winner.copy"))
    marked = rows.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), wins.alias("wins"), "times").where("NOT wins OR times > 1")
    marked = materialize(marked, "marked")
    # The row travels whole, so its other columns may have any name.
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("_own"), _copy(text_col).alias("_text"))
    every = every.join(small(marked), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_copy")), "left")
    alone = every.where("wins IS NULL").select("row")
    out = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if marked.where("wins").isEmpty():  # no rows alike in id and text
        return alone.select(*out)
    alike = every.where("wins").select("row", "_id", "_copy", F.row_number().over(Window.partitionBy("_id", "_copy").orderBy("_copy")).alias("rank")).where("rank = 1").select("row")
    return alone.unionByName(alike).select(*out)
