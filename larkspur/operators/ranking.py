"""Nearest neighbours, top-k, recommendation, reranking, filters and boosts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.vectors import cosine, dot, norm, pooled, unit
from larkspur.sources.shared import Scratch

#: Fixed weights and ranges of the hybrid reranker.
WEIGHTS = {"cf": 0.3, "content": 0.4, "popularity": 0.2, "quality": 0.1}
COLD_WEIGHTS = {"content": 0.6, "popularity": 0.3, "quality": 0.1}
RANGES = {"cf": (0.0, 1.5), "content": (-1.0, 1.0), "popularity": (0.0, 6.0), "quality": (1.0, 5.0)}
#: Fixed weights of the search reranker; recency counts as a constant.
SEARCH_WEIGHTS = {"semantic": 0.50, "popularity": 0.25, "quality": 0.15, "recency": 0.10}


PAIR = "q long, i long, score double"


def top_k(df: DataFrame, by: list[str], score: str, k: int, tie: str) -> DataFrame:
    """The k best rows of each group with rank; ties go to the smaller `tie`."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_blocks(vectors: DataFrame, block: int, run: Callable[..., DataFrame], empty: str, unit: bool = False, codes: bool = False, lazy: bool = False) -> DataFrame:
    """The union of run(ids, matrix[, codes]) over blocks of about `block` vectors (q, qv[, codes]) by hash.

    With several blocks, each one's rows are written before the next is fetched, so neither the driver nor a plan ever
    holds more than one block. One block runs with the query that reads it. With `lazy`, nothing is written, and the plan
    holds all blocks: for stated queries, of which all pairs are too many to write.
    """
    spark = vectors.sparkSession
    blocks = max(1, -(-vectors.count() // block))
    scratch = Scratch(spark, "blocks") if blocks > 1 and not lazy else None
    found, names, out = spark.createDataFrame([], empty), [], None
    for b in range(blocks):
        rows = vectors.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "qv", *["codes"] * codes).toArrow()
        if rows.num_rows:
            own = run(rows["q"].to_numpy(), _matrix(rows["qv"], unit), *([_codes(rows["codes"])] if codes else []))
            if scratch is None:
                out = own if out is None else out.unionByName(own)
                continue
            scratch.write(own, f"block={b}")
            names.append(f"{scratch.folder}/block={b}")
    if out is not None:
        return out
    return spark.read.schema(found.schema).parquet(*names) if names else found


def scored_pairs(queries: DataFrame, items: DataFrame, cosine: bool = False, block: int = 4096, exclude_self: bool = False, scaled: bool = False) -> DataFrame:
    """(q, i, score) of every stated query vector against every item: queries (q, qv), items (i, iv).

    Blocks of queries are sent to the items' partitions and scored by matrix products; the blocks' rows are one union,
    neither written nor shuffled. With `scaled`, scores are scaled to 0..1 within a query (0.5 where all are equal), of
    pairs without the query itself: a first pass gives each query's ends, two numbers a query and partition. Where only
    the best are wanted, knn_matrix() keeps them within each partition.
    """

    def run(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        low = high = None
        if scaled:
            found = _ends(ids, matrix, items, cosine).groupBy("q").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()
            at = np.argsort(found["q"].to_numpy())
            place = np.minimum(np.searchsorted(found["q"].to_numpy()[at], ids), max(len(at) - 1, 0))
            low, high = (found[c].to_numpy()[at][place] if len(at) else np.zeros(len(ids)) for c in ("low", "high"))

        def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, scores in _products(it, matrix, cosine):
                other = i[:, None] != ids[None, :] if exclude_self or scaled else np.ones(scores.shape, bool)
                if scaled:
                    scores = np.where(high > low, (scores - low) / np.where(high > low, high - low, 1.0), 0.5)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids, scores.shape)[other]), pa.array(np.broadcast_to(i[:, None], scores.shape)[other]), pa.array(scores[other])], ["q", "i", "score"])

        return items.select("i", "iv").mapInArrow(scored, PAIR)

    return in_blocks(queries, block, run, PAIR, cosine, lazy=True)


def _products(it: Iterator[pa.RecordBatch], matrix: np.ndarray, cosine: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of a few items at a time: a row for each, a column for each query."""
    step = max(1, 1_000_000 // max(len(matrix), 1))
    for batch in it:
        if batch.num_rows:
            own, i = _matrix(batch.column("iv"), cosine), batch.column("i").to_numpy(zero_copy_only=False)
            for at in range(0, len(i), step):
                yield i[at : at + step], own[at : at + step] @ matrix.T


def _ends(ids: np.ndarray, matrix: np.ndarray, items: DataFrame, cosine: bool) -> DataFrame:
    """(q, low, high) of each partition."""

    def ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
        for i, scores in _products(it, matrix, cosine):
            other = i[:, None] != ids[None, :]
            low, high = np.minimum(low, np.where(other, scores, np.inf).min(axis=0)), np.maximum(high, np.where(other, scores, -np.inf).max(axis=0))
        met = high >= low
        yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(low[met]), pa.array(high[met])], ["q", "low", "high"])

    return items.select("i", "iv").mapInArrow(ends, "q long, low double, high double")


#: Cells into which a pass over all scores cuts a range, and scores that are fetched to end the search.
CELLS, FETCHED = 65_536, 200_000


def score_quantiles(queries: DataFrame, items: DataFrame, shares: tuple[float, ...], cosine: bool = False, block: int = 4096) -> tuple[dict, list[float]]:
    """Count, low, high, mean and deviation of the scores of all pairs of scored_pairs(), and their exact quantiles, between
    neighbours in proportion.

    No pair leaves its task: a pass counts the scores of each partition in CELLS cells of a range; the range is cut to the
    cell that holds a wanted rank until it has few scores, of which a last pass gives the distinct ones with counts.
    """

    def over(made: Callable[[np.ndarray, dict], None]) -> DataFrame:
        """Rows (k, x): what made(scores of a few items, what is there) puts together within a partition."""

        def run(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
            def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total: dict = {}
                for i, scores in _products(it, matrix, cosine):
                    made(scores[i[:, None] != ids[None, :]], total)
                if "cells" in total:
                    total = {float(k): float(total["cells"][k]) for k in np.flatnonzero(total["cells"]).tolist()}
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.float64()), pa.array(list(total.values()), pa.float64())], ["k", "x"])

            return items.select("i", "iv").mapInArrow(counted, "k double, x double")

        return in_blocks(queries, block, run, "k double, x double", cosine, lazy=True)

    def moments(s: np.ndarray, total: dict) -> None:
        if len(s):
            for k, x, put in ((0.0, float(len(s)), np.add), (1.0, float(s.sum()), np.add), (2.0, float((s * s).sum()), np.add), (3.0, float(s.min()), np.minimum), (4.0, float(s.max()), np.maximum)):
                total[k] = float(put(total[k], x)) if k in total else x

    found = {r.k: r for r in over(moments).groupBy("k").agg(F.sum("x").alias("sum"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    if not found:
        return {"n": 0, "low": None, "high": None, "mean": None, "std": None}, [None] * len(shares)
    n, mean, low, high = int(found[0.0].sum), found[1.0].sum / found[0.0].sum, found[3.0].low, found[4.0].high
    summary = {"n": n, "low": low, "high": high, "mean": mean, "std": float(np.sqrt(max(found[2.0].sum / n - mean * mean, 0.0)))}

    def ranked(rank: int) -> float:
        """The score of a rank, from 0."""
        below, a, b = 0, low, high
        inside = n
        while inside > FETCHED:
            edges = np.linspace(a, b, CELLS + 1)

            def cells(s: np.ndarray, total: dict, edges=edges) -> None:
                s = s[(s >= edges[0]) & (s <= edges[-1])]
                span = edges[-1] - edges[0]
                if span > 1e-9 * max(abs(edges[0]), abs(edges[-1])):
                    # By arithmetic, which may be off by one.
                    at = np.clip((s - edges[0]) * (CELLS / span), 0, CELLS - 1).astype(np.int64)
                    at += (s >= edges[at + 1]).astype(np.int64) - (s < edges[at])
                else:
                    at = np.searchsorted(edges, s, side="right") - 1
                total["cells"] = total.get("cells", 0) + np.bincount(np.clip(at, 0, CELLS - 1), minlength=CELLS)

            counts = np.zeros(CELLS, np.int64)
            for r in over(cells).groupBy("k").agg(F.sum("x").alias("x")).collect():
                counts[int(r.k)] = int(r.x)
            at = int(np.searchsorted(np.cumsum(counts), rank - below, side="right"))
            below, inside = below + int(counts[:at].sum()), int(counts[at])
            last = at == CELLS - 1
            if not edges[at] < edges[at + 1] or (a, b) == (edges[at], edges[at + 1] if last else np.nextafter(edges[at + 1], -np.inf)):
                return float(edges[at])
            a, b = float(edges[at]), float(edges[at + 1]) if last else float(np.nextafter(edges[at + 1], -np.inf))
            if a == b:
                return a

        def values(s: np.ndarray, total: dict, a=a, b=b) -> None:
            for x, c in zip(*(y.tolist() for y in np.unique(s[(s >= a) & (s <= b)], return_counts=True)), strict=True):
                total[x] = total.get(x, 0.0) + c

        rows = sorted((r.k, int(r.x)) for r in over(values).groupBy("k").agg(F.sum("x").alias("x")).collect())
        return rows[int(np.searchsorted(np.cumsum([c for _, c in rows]), rank - below, side="right"))][0]

    quantiles = []
    for share in shares:
        place = share * (n - 1)
        first = int(np.floor(place))
        one = ranked(first)
        quantiles.append(one if first == place else one + (place - first) * (ranked(first + 1) - one))
    return summary, quantiles


def knn_matrix(queries: DataFrame, items: DataFrame, k: int, cosine: bool = True, exclude_self: bool = False, block: int = 4096, weight: float = 1.0, equal: tuple[float, ...] = (), within: bool = False) -> DataFrame:
    """(q, i, score, rank): exact nearest neighbours by matrix products, with scores rounded to 9 digits, ties to the
    smaller i.

    Queries (q, qv) go in blocks to the items' partitions; a partition gives its own k best of each query, see Best. With
    `equal`, both sides have an array `codes` of as many longs, and a score is weight times the product plus equal[n]
    where the n-th codes are the same. `within` takes only items whose codes are the query's (nulls: none).
    """
    coded = bool(equal) or within

    def run(ids: np.ndarray, matrix: np.ndarray, *codes: np.ndarray) -> DataFrame:
        def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = Best(matrix, k, weight, equal, *codes)
            for batch in it:
                if batch.num_rows:
                    i = batch.column("i").to_numpy(zero_copy_only=False)
                    theirs = _codes(batch.column("codes")) if coded else None

                    def hide(rows: np.ndarray, part: slice, i=i, theirs=theirs) -> np.ndarray:
                        out = ids[rows][:, None] == i[None, part] if exclude_self else np.zeros((len(rows), len(i[part])), bool)
                        for own, their in zip(codes[0].T, theirs.T, strict=True) if within else ():
                            out |= own[rows][:, None] != their[None, part]
                        return out

                    kept.offer(_matrix(batch.column("iv"), cosine), i, hide if exclude_self or within else None, theirs if equal else None)
            at, i, scores = kept.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(i), pa.array(scores)], ["q", "i", "score"])

        return top_k(items.select("i", "iv", *["codes"] * coded).mapInArrow(best, PAIR), ["q"], "score", k, "i")

    if within:
        queries, items = (x.where(~F.exists("codes", lambda c: c.isNull())) for x in (queries, items))
    return in_blocks(queries, block, run, PAIR + ", rank int", cosine, coded)


class Best:
    """The k best items of each query (a row of `queries`) among those offered: by dot product rounded to 9 digits, ties
    to the smaller id. With `equal`, scores are as in knn_matrix().

    Products are taken in single precision first. Only pairs that may still be among the k best, by the bound of its
    error, are computed in double precision, so results are exact. Items offered longest first end early: no product
    exceeds that of the lengths. What is held is k pairs a query, as many that wait, and CHUNK products.
    """

    CHUNK = 1_000_000

    def __init__(self, queries: np.ndarray, k: int, weight: float = 1.0, equal: tuple[float, ...] = (), codes: np.ndarray | None = None):
        self.queries, self.k, self.weight, self.equal, self.codes = queries, k, weight, equal, codes
        self.small = queries
        self.norms = np.linalg.norm(queries, axis=1) if queries.size else np.zeros(len(queries))
        self.least = np.full(len(queries), -np.inf)  # the k-th best score so far
        self.held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def offer(self, own: np.ndarray, ids: np.ndarray, hide: Callable | None = None, codes: np.ndarray | None = None, among: np.ndarray | None = None) -> None:
        """Items' vectors and ids, for all queries or those of a mask; hide(rows, part) is a mask or an index of the pairs of these
        queries and this slice of the items that don't count."""
        lengths = np.linalg.norm(own, axis=1)
        longest = np.maximum.accumulate(lengths[::-1])[::-1]  # of this item and all after it
        top = self.norms.max(initial=0.0) * longest.max(initial=0.0)
        kind = np.float32 if top < 1e30 and longest.max(initial=0.0) < 1e30 and self.norms.max(initial=0.0) < 1e30 else np.float64
        if self.small.dtype != kind:
            self.small = self.queries.astype(kind)
        small, theirs = self.small, own.astype(kind)
        slip = (own.shape[1] + 8) * float(np.finfo(kind).eps) * abs(self.weight)
        more = sum(x for x in self.equal if x > 0)
        at = 0
        while at < len(ids):
            reach = self.norms * longest[at]
            margin = slip * reach + 4 * float(np.finfo(kind).eps) * (more + sum(abs(x) for x in self.equal)) + 2e-9
            able = abs(self.weight) * reach + more + margin >= self.least
            rows = np.flatnonzero(able if among is None else able & among)
            if not len(rows):
                return
            step = max(1, self.CHUNK // len(rows))
            if np.isneginf(self.least).any():
                step = max(step, 4 * self.k)
            part = slice(at, min(at + step, len(ids)))
            at += step
            for lo in range(0, len(rows), max(1, 8 * self.CHUNK // step)):
                self._chunk(rows[lo : lo + max(1, 8 * self.CHUNK // step)], small, theirs, own, ids, part, margin, hide, codes)

    def _chunk(self, rows, small, theirs, own, ids, part, margin, hide, codes) -> None:
        theirs, own, ids, codes = theirs[part], own[part], ids[part], None if codes is None else codes[part]
        scores = (small if len(rows) == len(small) else small[rows]) @ theirs.T
        if self.equal:
            scores *= small.dtype.type(self.weight)
            for n, more in enumerate(self.equal):
                scores += small.dtype.type(more) * (self.codes[rows, n][:, None] == codes[None, :, n])
        if hide is not None:
            scores[hide(rows, part)] = -np.inf
        least = self.least[rows]
        if (new := np.flatnonzero(np.isneginf(least))).size and scores.shape[1] > self.k:
            least[new] = np.partition(np.nan_to_num(scores[new], nan=-np.inf), -self.k, axis=1)[:, -self.k] - margin[rows[new]]
        bound = (least - margin[rows]).astype(scores.dtype)
        flat = np.flatnonzero((scores >= bound[:, None]) & (scores > -np.inf) if np.isneginf(bound).any() else scores >= bound[:, None])
        r, j = np.divmod(flat, scores.shape[1])
        q = rows[r]
        exact = np.empty(len(q))
        for lo in range(0, len(q), 50_000):
            hi = lo + 50_000
            exact[lo:hi] = np.einsum("ij,ij->i", self.queries[q[lo:hi]], own[j[lo:hi]])
        if self.equal:
            exact *= self.weight
            for n, more in enumerate(self.equal):
                exact += more * (self.codes[q, n] == codes[j, n])
        exact = np.round(exact, 9)
        good = np.isfinite(exact) & (exact >= self.least[q])
        self.waiting.append((q[good], ids[j[good]], exact[good]))
        self.n_waiting += int(good.sum())
        if self.n_waiting > max(len(self.held[0]), 4 * len(self.queries)):
            self._merge()

    def resume(self, counts: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Begin with lists made before: so many ids and scores of each query."""
        self.waiting.append((np.repeat(np.arange(len(counts)), counts), ids, scores))
        self._merge()

    def settled(self, length: float) -> np.ndarray:
        """Which queries' lists no item of at most this length can change."""
        return self.least > self.norms * length * (1 + 1e-9) + 2e-9

    def _merge(self) -> None:
        q, i, s = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        last = place == self.k - 1
        self.least[q[last]] = s[last]
        inside = place < self.k
        self.held, self.waiting, self.n_waiting = (q[inside], i[inside], s[inside]), [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of queries, ids, scores), the best first within a query."""
        if self.waiting:
            self._merge()
        return self.held


def top_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Which scores are among their row's k largest, or equal the last of them; never -inf."""
    k = min(k, scores.shape[1])
    last = np.partition(scores, -k, axis=1)[:, -k]
    return (scores >= last[:, None]) & np.isfinite(scores)


def ivf_index(items: DataFrame, cells: int | None = None, sample: int = 20_000, seed: int = 7) -> tuple[DataFrame, np.ndarray]:
    """An inverted-file index of item vectors (i, iv): (i, iv, cell) for every item, and the cells' unit centroids.

    The centroids are Spark's k-means of at most `sample` items by hash; there are the square root of the number of
    items, from 10 to 100, unless `cells` says otherwise. Every item is indexed under its nearest centroid.
    """
    n = items.count()
    cells = cells or int(min(max(np.sqrt(n), 10), 100))
    some = items if n <= sample else items.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    ready = some.select(array_to_vector(unit(F.col("iv"))).alias("features"))
    centres = np.array(KMeans(k=cells, seed=seed).fit(ready).clusterCenters())
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cell = (_matrix(b.column("iv"), True) @ centres.T).argmax(axis=1).astype(np.int32) if b.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("iv"), pa.array(cell)], ["i", "iv", "cell"])

    kind = dict(items.dtypes)["i"]
    return items.select("i", "iv").mapInArrow(assign, f"i {kind}, iv array<double>, cell int"), centres


def ivf_search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int = 10, exclude_self: bool = True) -> DataFrame:
    """(q, i, score, rank): the best by cosine among the items of the `probes` cells nearest to each query.

    Queries go in blocks to the items' partitions, where the items of a cell meet the queries that probe it in a matrix
    product; a partition gives its own k best of each query, see Best.
    """

    def run(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = Best(matrix, k)
            near = np.argsort(-(matrix @ centres.T), axis=1, kind="stable")[:, :probes]
            asks = np.zeros((len(centres), len(ids)), bool)
            asks[near, np.arange(len(ids))[:, None]] = True
            for b in it:
                if b.num_rows:
                    cell = b.column("cell").to_numpy()
                    order = np.argsort(cell, kind="stable")
                    i, own = b.column("i").to_numpy(zero_copy_only=False)[order], _matrix(b.column("iv"), True)[order]
                    for c, at in zip(*np.unique(cell[order], return_index=True), strict=True):
                        part = slice(at, at + int((cell == c).sum()))
                        mine = i[part]
                        hide = (lambda rows, p, mine=mine: ids[rows][:, None] == mine[None, p]) if exclude_self else None
                        kept.offer(own[part], mine, hide, among=asks[c])
            at, i, scores = kept.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(i), pa.array(scores)], ["q", "i", "score"])

        return top_k(index.select("i", "iv", "cell").mapInArrow(best, PAIR), ["q"], "score", k, "i")

    return in_blocks(queries, 4096, run, PAIR + ", rank int", unit=True)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (q, i) that were found."""
    n = exact.count()
    return exact.join(found.select("q", "i"), ["q", "i"], "left_semi").count() / n if n else 1.0


def _matrix(column, unit: bool) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0) if unit else m


def _codes(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def exclude_pairs(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(seen.select(*keys), keys, "left_anti")


def unseen_of(pool: DataFrame, users: DataFrame, seen: DataFrame, user: str = "user_id", item: str = "product_id") -> DataFrame:
    """(user, free): for each of users, the items of `pool` (item, n) that the user has no row of `seen` with, the most
    frequent first. The pool has a stated length, and travels as one array; a user's history counts only where it
    meets the pool, so users are never multiplied by items."""
    ids = pool.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(item).alias("item")))), lambda x: x["item"]).alias("_pool"))
    held = seen.join(F.broadcast(pool.select(item)), item, "left_semi").groupBy(user).agg(F.collect_set(item).alias("_seen"))
    rows = users.select(user).distinct().join(held, user, "left").crossJoin(F.broadcast(ids))
    return rows.select(user, F.when(F.col("_seen").isNull(), F.col("_pool")).otherwise(F.array_except("_pool", "_seen")).alias("free"))


def popular_unseen(interactions: DataFrame, k: int, pool: int, users: DataFrame | None = None) -> DataFrame:
    """(user_id, product_id, n, rank): each user's k most popular items that they haven't touched.

    A pool of the most popular items serves most users. Those whom it leaves short have a long history; they get a
    pool longer than the longest of those histories, so every user's list is exact.
    """
    scratch = Scratch(interactions.sparkSession, "popular")
    interactions = scratch.write(interactions.select("user_id", "product_id"), "pairs")
    counts = scratch.write(interactions.groupBy("product_id").agg(F.count("*").alias("n")), "counts")
    top = lambda size, name: scratch.write(counts.orderBy(F.desc("n"), "product_id").limit(size), name)
    users = (users if users is not None else interactions).select("user_id").distinct()
    popular = top(pool, "pool")
    free = unseen_of(popular, users, interactions)
    enough = free.where(F.size("free") >= k)
    if popular.count() < pool:  # the pool is all there is
        enough = free
    else:
        short = free.where(F.size("free") < k).select("user_id")
        longest = interactions.join(short, "user_id", "left_semi").groupBy("user_id").agg(F.count_distinct("product_id").alias("n")).agg(F.max("n")).first()[0]
        if longest is not None:
            popular = top(longest + k, "longer")
            enough = enough.unionByName(unseen_of(popular, short, interactions))
    listed = enough.select("user_id", F.posexplode(F.slice("free", 1, k)).alias("rank", "product_id"))
    return listed.join(F.broadcast(popular), "product_id").select("user_id", "product_id", "n", (F.col("rank") + 1).alias("rank"))


def popularity_fallback(popular: DataFrame, users: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """(user_id, product_id, score, rank): the k most popular items (product_id, n) that a user hasn't touched, scored by
    their share of the largest count. The list has a stated length."""
    most = popular.agg(F.max("n").alias("most"))
    listed = unseen_of(popular, users, seen).select("user_id", F.posexplode(F.slice("free", 1, k)).alias("rank", "product_id"))
    scored = popular.crossJoin(F.broadcast(most)).select("product_id", (F.col("n") / F.col("most")).alias("score"))
    return listed.join(F.broadcast(scored), "product_id").select("user_id", "product_id", "score", (F.col("rank") + 1).alias("rank"))


def hybrid_fallback(profiles: DataFrame, items: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(q, i, score, rank): the best of weight * cosine + (1 - weight) * popularity; profiles are (q, qv), items (i, iv,
    popularity). One dot product does both: each vector gets a place more."""
    a = profiles.select("q", F.concat(F.transform(unit(F.col("qv")), lambda x: x * weight), F.array(F.lit(1 - weight))).alias("qv"))
    b = items.select("i", F.concat(unit(F.col("iv")), F.array(F.col("popularity").cast("double"))).alias("iv"))
    return knn_matrix(a, b, k, cosine=False)


def fallback(strategy: str, **given) -> DataFrame:
    """Lists for users without a model, by name: popularity (popularity_fallback), similarity (knn_matrix on their
    profiles) or hybrid (hybrid_fallback), with that function's arguments; ValueError for another name."""
    ways = {"popularity": popularity_fallback, "similarity": knn_matrix, "hybrid": hybrid_fallback}
    if strategy not in ways:
        raise ValueError(f"{strategy}: one of {sorted(ways)}")
    return ways[strategy](**given)


def content_score(asked: DataFrame, items: DataFrame, k: int, weights=(0.7, 0.2, 0.1), other_brand: float = 0.3) -> DataFrame:
    """(q, i, score, rank): the best of weights * (cosine, same category, same brand or other_brand), of rows (id, vec,
    brand, category). What is missing equals nothing."""
    own = lambda missing: F.array(*[F.when(F.col(c).isNull(), F.lit(missing)).otherwise(F.xxhash64(c)) for c in ("category", "brand")])
    q = asked.select(F.col("id").alias("q"), F.col("vec").alias("qv"), own(-1).alias("codes"))
    i = items.select(F.col("id").alias("i"), F.col("vec").alias("iv"), own(-2).alias("codes"))
    found = knn_matrix(q, i, k, exclude_self=True, weight=weights[0], equal=(weights[1], weights[2] * (1 - other_brand)))
    return found.withColumn("score", F.round(F.col("score") + weights[2] * other_brand, 9))


def sigmoid_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """Scores as the sigmoid of their distance from the mean in standard deviations."""
    ends = df.agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    z = (F.col(score) - F.col("_m")) / F.col("_s")
    return df.crossJoin(F.broadcast(ends)).withColumn(score, 1 / (1 + F.exp(-z))).drop("_m", "_s")


def embedding_quality(vectors: DataFrame, items: DataFrame) -> DataFrame:
    """(norm_quality, mean_abs_cos, coverage): 1 / (1 + variation of the norms), the mean absolute cosine of vectors of an
    id divisible by 100 to all others, and the share of items (id) that have a vector. vectors is (id, vec)."""
    n = vectors.select(norm(F.col("vec")).alias("n")).agg((1 / (1 + F.stddev_pop("n") / F.avg("n"))).alias("norm_quality"))
    asked, every = vectors.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("vec").alias("qv")), vectors.select(F.col("id").alias("i"), F.col("vec").alias("iv"))

    def run(ids: np.ndarray, matrix: np.ndarray) -> DataFrame:
        def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = 0.0, 0
            for b in it:
                if b.num_rows:
                    scores = np.abs(_matrix(b.column("iv"), True) @ matrix.T)
                    other = b.column("i").to_numpy()[:, None] != ids[None, :]
                    total, n = total + float(scores[other].sum()), n + int(other.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], ["total", "n"])

        return every.mapInArrow(summed, "total double, n long")

    near = in_blocks(asked, 4096, run, "total double, n long", unit=True).agg((F.sum("total") / F.sum("n")).alias("mean_abs_cos"))
    held = items.join(vectors.select("id", F.lit(1).alias("hit")), "id", "left").agg((F.count("hit") / F.count("*")).alias("coverage"))
    return n.crossJoin(near).crossJoin(held)


def popular_by_factors(users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item, s): the k items with the largest sum of dot products with all users (q, qv) but themselves; items are (i, iv).
    The sum over users is one product with the sum of their vectors, so no pair is made."""
    whole = pooled(users.withColumn("one", F.lit(1)).select("one", "qv"), "one", "qv").crossJoin(users.agg(F.count("*").alias("n")))
    mean = F.broadcast(whole.select(F.col("qv").alias("mean"), "n"))  # one row
    own = users.select(F.col("q").alias("i"), F.lit(1).alias("own"))
    met = items.join(own, "i", "left").crossJoin(mean)
    score = dot(F.col("iv"), F.col("mean")) * F.col("n") - F.when(F.col("own") == 1, dot(F.col("iv"), F.col("iv"))).otherwise(0.0)
    return met.select(F.col("i").alias("item"), score.alias("s")).orderBy(F.desc("s"), "item").limit(k)


#: The fixed hash of random_lists(): (q * BY_USER + i * BY_ITEM + 17) % CIRCLE; items that a task holds before it drops those
#: that can be in no list.
BY_USER, BY_ITEM, CIRCLE, ITEMS_HELD = 7919, 104729, 1_000_003, 1_000_000


def random_lists(users: DataFrame, items: DataFrame, k: int, block: int = 65_536) -> DataFrame:
    """(q, i, score, rank): for each of stated users (q) the k items (i) with the largest value of a fixed hash of both;
    ties go to the smaller item. A partition gives its own k best.

    The hash is an item's place on a circle, turned by the user. So the k best of all users are runs of one order of the
    items, found by binary search, and pairs are never made. Of items at one place only the k smallest are held.
    """

    def held(place: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By place, the farthest first, then by item; at most k of a place."""
        order = np.lexsort((i, -place))
        place, i = place[order], i[order]
        kept = np.arange(len(i)) - np.searchsorted(-place, -place) < k
        return place[kept], i[kept]

    def run(ids: np.ndarray, _: np.ndarray) -> DataFrame:
        turn = ids * BY_USER % CIRCLE

        def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, every, parts, waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
            for b in it:
                parts.append(b.column("i").to_numpy().astype(np.int64))
                waiting += len(parts[-1])
                if waiting > max(ITEMS_HELD, len(every)):
                    every = np.concatenate([every, *parts])
                    place, every = held((every * BY_ITEM + 17) % CIRCLE, every)
                    parts, waiting = [], 0
            every = np.concatenate([every, *parts])
            place, every = held((every * BY_ITEM + 17) % CIRCLE, every)
            n = min(k, len(every))
            for lo in range(0, len(ids) if n else 0, 4096):
                own = turn[lo : lo + 4096]
                # The farthest place that the turn doesn't carry over the end of the circle, and on from there.
                at = (np.searchsorted(-place, -(CIRCLE - 1 - own))[:, None] + np.arange(n)) % len(every)
                scores = ((place[at] + own[:, None]) % CIRCLE).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + 4096], n)), pa.array(every[at].ravel()), pa.array(scores.ravel())], ["q", "i", "score"])

        return top_k(items.where("i IS NOT NULL").select(F.col("i").cast("long").alias("i")).mapInArrow(best, PAIR), ["q"], "score", k, "i")

    return in_blocks(users.select(F.col("q").cast("long").alias("q"), F.array(F.lit(0.0)).alias("qv")), block, run, PAIR + ", rank int")


def probes_for(queries: DataFrame, items: DataFrame, index: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
    """The least number of probes (10 or more, doubling) that reaches a recall against brute force on these queries."""
    exact = Scratch(queries.sparkSession, "probes").write(knn_matrix(queries, items, k, exclude_self=True), "exact")
    probes = 10
    while probes < len(centres) and recall_of(ivf_search(queries, index, centres, k, probes), exact) < recall:
        probes *= 2
    return min(probes, len(centres))


def min_max(score: Column, by: list[str]) -> Column:
    """Scaled to 0..1 within a group; 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (score - low) / (high - low)).otherwise(0.5)


def clipped(score: Column, low: Column | float, high: Column | float) -> Column:
    """Scaled from low..high to 0..1 and clipped; 0.5 for an empty range."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(high > low, F.least(F.greatest((score - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(0.5)


def score_range(df: DataFrame, score: str) -> DataFrame:
    p = F.percentile(score, F.array(F.lit(0.01), F.lit(0.99)))
    row = df.agg(F.min(score).alias("low"), F.max(score).alias("high"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), p.alias("p"))
    return row.select(*[F.round(c, 6).alias(c) for c in ("low", "high", "mean", "std")], F.round(F.col("p")[0], 6).alias("p01"), F.round(F.col("p")[1], 6).alias("p99"))


def combine(df: DataFrame, weights: dict[str, float] = WEIGHTS, ranges=RANGES, missing: float = 0.0) -> DataFrame:
    """final_score: each signal scaled by its fixed range, then weighted."""
    parts = [F.lit(w) * clipped(F.coalesce(F.col(s), F.lit(missing)), *ranges[s]) for s, w in weights.items()]
    return df.withColumn("final_score", sum(parts[1:], parts[0]))


def diversity_penalty(df: DataFrame, by: str, item: str, score: str, vec: str, threshold: float = 0.85, penalty: float = 0.1) -> DataFrame:
    """Scores lowered where an item is near a higher-scored one of its list. The comparison is with every higher-scored
    item, penalised or not, so it is a join of the list with itself and one maximum. Lists are short by construction."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(item).asc())
    ordered = df.withColumn("_ord", F.row_number().over(w))
    higher = ordered.select(F.col(by).alias("_by"), F.col("_ord").alias("_above"), F.col(vec).alias("_vec"))
    near = ordered.join(higher, (F.col(by) == F.col("_by")) & (F.col("_above") < F.col("_ord")))
    sims = near.groupBy(by, item).agg(F.greatest(F.max(cosine(F.col(vec), F.col("_vec"))), F.lit(0.0)).alias("max_sim"))
    out = ordered.join(sims, [by, item], "left").withColumn("max_sim", F.coalesce("max_sim", F.lit(0.0)))
    factor = F.when(F.col("max_sim") > threshold, 1 - penalty * (F.col("max_sim") - threshold) / (1 - threshold)).otherwise(1.0)
    return out.withColumn(score, F.col(score) * factor).drop("_ord")


def list_diversity(df: DataFrame, by: str, vec: str, order: str, short: float = 0.0) -> DataFrame:
    """(by, diversity): 1 less the mean cosine of all pairs of a list, clipped to 0..1; `short` for under two items."""
    a = df.select(by, F.col(order).alias("_a"), F.col(vec).alias("_va"))
    b = df.select(F.col(by).alias("_by"), F.col(order).alias("_b"), F.col(vec).alias("_vb"))
    pairs = a.join(b, (F.col(by) == F.col("_by")) & (F.col("_a") < F.col("_b")))
    mean = pairs.groupBy(by).agg(F.avg(cosine(F.col("_va"), F.col("_vb"))).alias("_m"))
    value = F.when(F.col("_m").isNull(), F.lit(short)).otherwise(F.least(F.greatest(1 - F.col("_m"), F.lit(0.0)), F.lit(1.0)))
    return df.select(by).distinct().join(mean, by, "left").select(by, F.round(value, 6).alias("diversity"))


def search_score(df: DataFrame, weights=SEARCH_WEIGHTS) -> DataFrame:
    """final_score of search hits: similarity, log popularity capped at 100,000 sales, quality over 5, constant recency."""
    pop = F.coalesce(F.nullif(F.col("popularity"), F.lit(0.0)), F.col("num_sold").cast("double"), F.lit(0.0))
    pop = F.least(F.log1p(pop) / F.log1p(F.lit(100_000.0)), F.lit(1.0))
    quality = F.coalesce(F.col("avg_star") / 5, F.lit(0.5))
    parts = {"semantic": F.col("semantic"), "popularity": pop, "quality": quality, "recency": F.lit(0.5)}
    terms = [F.lit(weights[n]) * c for n, c in parts.items()]
    return df.withColumn("final_score", sum(terms[1:], terms[0]))


def attribute_filter(price_min=None, price_max=None, min_rating=None, **equal) -> Column:
    """A list's predicate: a missing attribute passes, a missing price or rating counts as 0 (or as no upper bound)."""
    keep = F.lit(True)
    if price_min is not None:
        keep = keep & (F.coalesce("price", F.lit(0.0)) >= price_min)
    if price_max is not None:
        keep = keep & (F.coalesce("price", F.lit(float("inf"))) <= price_max)
    if min_rating is not None:
        keep = keep & (F.coalesce("avg_star", F.lit(0.0)) >= min_rating)
    for name, wanted in equal.items():
        c = F.col(name)
        held = F.exists(F.array(*map(F.lit, wanted)), lambda v: F.contains(c.cast("string"), v)) if isinstance(wanted, list | tuple) else c == wanted
        keep = keep & (c.isNull() | held)
    return keep


def index_filter(brand=None, category=None, price_min=None, price_max=None) -> Column:
    """The catalogue's predicate: trimmed, case-insensitive equality, and what is filtered on must be there."""
    keep = F.lit(True)
    for name, wanted in (("brand", brand), ("category", category)):
        if wanted is not None:
            keep = keep & (F.lower(F.trim(name)) == wanted.strip().lower())
    if price_min is not None:
        keep = keep & (F.col("price") >= price_min)
    if price_max is not None:
        keep = keep & (F.col("price") <= price_max)
    return keep


def cap_per_key(df: DataFrame, by: list[str], key: str, most: int = 3, rank: str = "rank") -> DataFrame:
    """The first `most` of each key in order, then the overflow in order; rows without a key never overflow."""
    n = F.row_number().over(Window.partitionBy(*by, key).orderBy(rank))
    over = F.when(F.col(key).isNull(), 0).otherwise((n > most).cast("int"))
    return df.withColumn("_over", over).withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy("_over", rank))).drop("_over")


def boost(df: DataFrame, rules: dict[str, list[tuple[str, float]]], score: str = "score") -> DataFrame:
    """Scores times a factor for the first rule of each attribute whose text it contains."""
    out = F.col(score)
    for column, values in rules.items():
        factor = None
        for text, by in values:
            here = F.contains(F.col(column), F.lit(text))
            factor = F.when(here, by) if factor is None else factor.when(here, by)
        out = out * factor.otherwise(1.0)
    return df.withColumn(score, out)


def preferences(df: DataFrame, by: str, attribute: str, n: int = 3) -> DataFrame:
    """(by, attribute, times, pref): each user's n most frequent values."""
    counts = df.where(F.col(attribute).isNotNull()).groupBy(by, attribute).agg(F.count("*").alias("times"))
    w = Window.partitionBy(by).orderBy(F.desc("times"), F.asc(attribute))
    return counts.withColumn("pref", F.row_number().over(w)).where(F.col("pref") <= n)


#: Fixed fusion weights (cf, content, popularity) by a user's number of interactions.
ADAPTIVE = ((2, (0.1, 0.6, 0.3)), (5, (0.3, 0.5, 0.2)), (10, (0.5, 0.35, 0.15)), (None, (0.6, 0.3, 0.1)))


def attention_logits(query: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A vector for each signal, of which the product with a user's vector is the signal's logit: query maps user vectors
    to the attention's dimensions, keys has a row for each signal."""
    return keys @ query.T


def attention_fusion(df: DataFrame, vec: str, logits: np.ndarray, temperature: float = 1.0, signals=("cf", "content", "popularity")) -> DataFrame:
    """df with the signals' weights (array `attention`, a softmax over the logits of the user's vector) and the `score`
    that they give."""
    each = F.array(*[dot(F.col(vec), F.array(*map(F.lit, row.tolist()))) / temperature for row in logits])
    out = df.withColumn("attention", each).withColumn("attention", F.transform("attention", lambda x: F.exp(x - F.array_max("attention"))))
    out = out.withColumn("attention", F.transform("attention", lambda x: x / F.aggregate("attention", F.lit(0.0), lambda a, y: a + y)))
    score = F.lit(0.0)
    for k, name in enumerate(signals):
        score = score + F.col("attention")[k] * F.col(name)
    return out.withColumn("score", score)


def adaptive_fusion(df: DataFrame, n: str, signals=("cf", "content", "popularity")) -> DataFrame:
    def mix(weights):
        return F.lit(weights[0]) * F.col(signals[0]) + F.lit(weights[1]) * F.col(signals[1]) + F.lit(weights[2]) * F.col(signals[2])

    out = None
    for below, weights in ADAPTIVE[:-1]:
        out = F.when(F.col(n) < below, mix(weights)) if out is None else out.when(F.col(n) < below, mix(weights))
    return df.withColumn("score", out.otherwise(mix(ADAPTIVE[-1][1])))
