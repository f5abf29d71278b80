"""Implicit-feedback models: ALS, BPR by partition-averaged SGD, samplers, weights, projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from larkspur.functions.vectors import norm, unit
from larkspur.operators.ranking import Best, unseen_of
from larkspur.sources.shared import Scratch

#: Fixed presets of the ALS trainer: rank, iterations, regularisation, alpha.
PRESETS = {"default": (64, 15, 0.1, 10.0), "fast": (32, 8, 0.1, 10.0), "sparse": (64, 15, 0.05, 40.0)}


def fit_als(matrix: DataFrame, preset: str = "default", seed: int = 42, **overrides) -> ALSModel:
    """MLlib's implicit ALS over (u_idx, i_idx, value)."""
    rank, iterations, reg, alpha = PRESETS[preset]
    args = {"rank": rank, "maxIter": iterations, "regParam": reg, "alpha": alpha} | overrides
    return ALS(userCol="u_idx", itemCol="i_idx", ratingCol="value", implicitPrefs=True, coldStartStrategy="drop", seed=seed, **args).fit(matrix)


#: Numbers of a block of item factors, and users that a task scores at once.
BLOCK_NUMBERS, USERS_AT_ONCE = 4_194_304, 2048
_STATE = "user_id long, uf array<double>, seen array<long>, best array<long>, scores array<double>, done boolean"


def recommend(user_factors: DataFrame, item_factors: DataFrame, seen: DataFrame, k: int, blocks: int = 1, block: int | None = None) -> DataFrame:
    """(user_id, item, score, rank) of unseen items by dot product; scores are rounded to 9 digits, ties go to the smaller item.

    Item factors are sent in blocks of about `block` (or in `blocks` at least), the longest factors first, to the users'
    partitions, where Best scores them and a user's own history is left out. From block to block, users carry their k
    best so far in a written table, and a user is done as soon as no factor to come is long enough to change the list.
    No scores are shuffled.
    """
    spark = user_factors.sparkSession
    n = max(1, item_factors.count())
    width = item_factors.select(F.size("features")).first()
    block = min(block or max(1, BLOCK_NUMBERS // max(1, width[0] if width else 1)), -(-n // blocks))
    own = seen.groupBy("user_id").agg(F.collect_set(F.col("item").cast("long")).alias("seen"))
    users = user_factors.select(F.col("id").cast("long").alias("user_id"), F.col("features").cast("array<double>").alias("uf")).join(own, "user_id", "left")
    # An empty history, not null: for each row, Arrow's writer goes over the run of nulls before it once more.
    users = users.withColumn("seen", F.coalesce("seen", F.array().cast("array<long>")))
    items = item_factors.select(F.col("id").cast("long").alias("q"), F.col("features").cast("array<double>").alias("qv"))
    if n <= block:
        rows = items.toArrow()
        found = users.mapInArrow(_best_of(*_factors(rows), k, None), _STATE) if rows.num_rows else spark.createDataFrame([], _STATE)
    else:
        scratch, names = Scratch(spark, "recommend"), []
        items = scratch.write(items.withColumn("length", norm(F.col("qv"))), "items")
        cuts = sorted(set(items.approxQuantile("length", [x * block / n for x in range(1, -(-n // block))], min(0.01, 0.1 * block / n))))
        band = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("length"))) if cuts else F.lit(0)
        items = scratch.write(items.withColumn("band", band), "bands")
        sizes = items.groupBy("band").agg(F.count("*").alias("n"), F.max("length").alias("most")).orderBy("band").collect()
        # A band of more than a block (factors of one length) is cut by hash.
        every = [(r.band, r.most, part, -(-r.n // block)) for r in sizes for part in range(-(-r.n // block))]
        for at, (b, _, part, parts) in enumerate(every):
            rows = items.where((F.col("band") == b) & (F.pmod(F.xxhash64("q"), F.lit(parts)) == part)).select("q", "qv").toArrow()
            rest = every[at + 1][1] if at + 1 < len(every) else None
            users = scratch.write(users.mapInArrow(_best_of(*_factors(rows), k, rest), _STATE), f"block={at}")
            names.append(f"{scratch.folder}/block={at}")
            users = users.where("NOT done")
            if rest is not None and users.isEmpty():
                break
        found = spark.read.schema(_STATE).parquet(*names).where("done")
    ranked = found.select("user_id", F.posexplode(F.arrays_zip("best", "scores")).alias("rank", "x"))
    return ranked.select("user_id", F.col("x.best").alias("item"), F.col("x.scores").alias("score"), (F.col("rank") + 1).alias("rank"))


def _factors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and factors, the longest first."""
    matrix = rows["qv"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 0))
    order = np.argsort(-np.linalg.norm(matrix, axis=1), kind="stable")
    return rows["q"].to_numpy()[order], matrix[order]


def _best_of(ids: np.ndarray, matrix: np.ndarray, k: int, rest: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Users' lists after a block of item factors; a user is done if none of length `rest` (None: none is left) can enter."""

    def lengths(column: pa.Array) -> np.ndarray:
        return pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy().astype(np.int64)

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = np.argsort(ids, kind="stable")
        ordered = ids[by_id]
        for whole in it:
            for lo in range(0, whole.num_rows, USERS_AT_ONCE):
                yield listed(whole.slice(lo, USERS_AT_ONCE), by_id, ordered)

    def listed(batch: pa.RecordBatch, by_id: np.ndarray, ordered: np.ndarray) -> pa.RecordBatch:
        size, history = batch.num_rows, batch.column("seen")
        kept = Best(batch.column("uf").flatten().to_numpy(zero_copy_only=False).reshape(size, -1), k)
        if "best" in batch.schema.names:
            kept.resume(lengths(batch.column("best")), batch.column("best").flatten().to_numpy(), batch.column("scores").flatten().to_numpy())
        if len(ids):
            # What users have seen of the block, by its place there.
            mine, of = history.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(size), lengths(history))
            at = np.minimum(np.searchsorted(ordered, mine), len(ids) - 1)
            here = ordered[at] == mine
            of, places = of[here], by_id[at[here]]
            turn = np.argsort(places, kind="stable")
            of, places = of[turn], places[turn]

            def hide(asked: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
                a, b = np.searchsorted(places, [part.start, part.stop])
                row = np.full(size, -1)
                row[asked] = np.arange(len(asked))
                r = row[of[a:b]]
                return r[r >= 0], places[a:b][r >= 0] - part.start

            kept.offer(matrix, ids, hide)
        user, found, scores = kept.rows()
        cuts = pa.array(np.searchsorted(user, np.arange(size + 1)).astype(np.int32))
        done = np.ones(size, bool) if rest is None else kept.settled(rest)
        left = [pa.compute.if_else(pa.array(done), pa.nulls(size, c.type), c) for c in (batch.column("uf"), history)]
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (found, scores)]
        return pa.RecordBatch.from_arrays([batch.column("user_id"), *left, *lists, pa.array(done)], ["user_id", "uf", "seen", "best", "scores", "done"])

    return best


def content_blend(user_factors: DataFrame, item_factors: DataFrame, profiles: DataFrame, vectors: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(user_id, item, score, rank): weight * factors' dot product + (1 - weight) * cosine of a user's content profile and
    an item's vector. Both are one dot product of longer vectors. profiles and vectors are (id, vec)."""
    both = lambda f, v, a, b: F.concat(F.transform(f, lambda x: x * a), F.transform(unit(v), lambda x: x * b))
    users = user_factors.join(profiles, "id").select("id", both(F.col("features").cast("array<double>"), F.col("vec"), weight, 1 - weight).alias("features"))
    items = item_factors.join(vectors, "id").select("id", both(F.col("features").cast("array<double>"), F.col("vec"), 1.0, 1.0).alias("features"))
    none = users.sparkSession.createDataFrame([], "user_id long, item long")
    return recommend(users, items, none, k)


def route(recommended: DataFrame, users: DataFrame, popular: DataFrame, k: int, seen: DataFrame) -> DataFrame:
    """(user_id, item, score, rank, fallback): model lists, and for users without one the k most popular items that they
    have no row of seen (user_id, item) with, scored by their share of the largest count. popular is (item, n).

    The popular list is as long as the longest history of the users without a list, and k more.
    """
    have = recommended.select("user_id").distinct()
    cold = users.select("user_id").distinct().join(have, "user_id", "left_anti")
    longest = seen.join(cold, "user_id", "left_semi").groupBy("user_id").agg(F.count_distinct("item").alias("n")).agg(F.max("n")).first()[0] or 0
    top = popular.orderBy(F.desc("n"), "item").limit(longest + k)
    listed = unseen_of(top, cold, seen, "user_id", "item").select("user_id", F.posexplode(F.slice("free", 1, k)).alias("rank", "item"))
    scored = listed.join(top, "item").join(F.broadcast(top.agg(F.max("n").alias("most"))))
    fallen = scored.select("user_id", "item", (F.col("n") / F.col("most")).alias("score"), (F.col("rank") + 1).alias("rank"), F.lit(True).alias("fallback"))
    return recommended.select("user_id", "item", "score", "rank", F.lit(False).alias("fallback")).unionByName(fallen)


def uniform_draw(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of keys: the same after a lost task."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def sample_negatives(pairs: DataFrame, n_items: int, per_pair: int = 4, draws: int = 8, seed: int = 0, hard: DataFrame | None = None, hard_share: float = 0.3) -> DataFrame:
    """(u_idx, i_idx, j_idx): for each positive pair, items drawn by hash that the user has no positive with; a share of
    them from `hard` (u_idx, j_idx) where the user has any. More draws than wanted are made and the first unseen stay;
    pairs that these leave short draw from the list of all items that their user has no positive with.

    A user's pairs are one row, in which all draws are made and checked: what is shuffled is the pairs, never their draws.
    """
    u, seen, none = F.col("u_idx"), F.col("seen"), F.array().cast("array<int>")
    # What an inner lambda reads is bound by a lambda of its own, as a column would be made anew for each element.
    bound = lambda value, use: F.transform(F.array(value), use)[0]
    place = lambda i, t, n, s: F.floor(uniform_draw(u, i, t, seed=s) * n).cast("int")
    tries = lambda i, first, last: F.transform(F.sequence(F.lit(first), F.lit(last)), lambda t: place(i, t, n_items, seed))
    users = pairs.groupBy("u_idx").agg(F.collect_set("i_idx").alias("seen"))
    own = lambda i: none
    if hard is not None:
        users = users.join(hard.groupBy("u_idx").agg(F.collect_set("j_idx").alias("hard")), "u_idx", "left")
        ordered = lambda i: F.sort_array(F.transform("hard", lambda j: F.struct(uniform_draw(u, i, j, seed=seed + 1).alias("h"), j.alias("j"))))
        own = lambda i: F.coalesce(F.transform(F.slice(ordered(i), 1, max(1, round(hard_share * per_pair))), lambda x: x["j"]), none)

    def found(i: Column, first: Column, met: Column) -> Column:
        """The hard and the unseen of the first draws, and of the others only where those are too few."""
        kept = F.concat(own(i), F.filter(first, lambda j: ~F.array_contains(met, j)))
        if draws < 2:
            return kept
        others = lambda: F.filter(tries(i, per_pair, per_pair * draws - 1), lambda j: ~F.array_contains(seen, j))
        return bound(kept, lambda k: F.when(F.size(k) >= per_pair, k).otherwise(F.concat(k, others())))

    def rest(i: Column, unseen: Column) -> Column:
        # Draws fall on equal places of the user's unseen items.
        drawn = F.transform(F.sequence(F.lit(0), F.lit(per_pair - 1)), lambda t: F.get(unseen, place(i, t, F.size(unseen), seed + 2)))
        return F.when(F.size(unseen) > 0, drawn).otherwise(none)

    first = F.transform(seen, lambda i: tries(i, 0, per_pair - 1))
    # Which of all first draws are seen is found by hash, once a user.
    drawn = bound(first, lambda f: bound(F.array_intersect(F.flatten(f), seen), lambda met: F.zip_with(seen, f, lambda i, js: F.struct(i.alias("i_idx"), found(i, js, met).alias("js")))))
    short = lambda x: F.size(x["js"]) < per_pair
    unseen = lambda rows: F.when(F.exists(rows, short), F.array_except(F.sequence(F.lit(0), F.lit(n_items - 1)), seen).cast("array<int>"))
    filled = lambda x, free: F.when(short(x), F.concat(x["js"], rest(x["i_idx"], free))).otherwise(x["js"])
    whole = bound(drawn, lambda rows: bound(unseen(rows), lambda free: F.transform(rows, lambda x: F.struct(x["i_idx"].alias("i_idx"), F.slice(filled(x, free), 1, per_pair).alias("js")))))
    return users.select("u_idx", F.explode(whole).alias("x")).select("u_idx", "x.i_idx", F.explode("x.js").alias("j_idx"))


def popularity_negatives(pairs: DataFrame, popularity: DataFrame, per_pair: int = 1, pool: int = 200, seed: int = 0) -> DataFrame:
    """Negatives from the `pool` most popular items with probability by count: the smallest exponential keys -ln(u) / n.
    A pair's keys are made and cut within its row, of the pool's items that its user has no positive with."""
    top = Scratch(popularity.sparkSession, "popular").write(popularity.orderBy(F.desc("n"), "i_idx").limit(pool), "pool")
    users = pairs.select("u_idx").distinct()
    free = unseen_of(top, users, pairs, "u_idx", "i_idx")
    counts = top.agg(F.map_from_entries(F.collect_list(F.struct("i_idx", "n"))).alias("_counts"))
    # Counts are looked up once a user. Users without a free item go here: a filter on a pair's keys, as an inner explode
    # brings one along, would make them once more.
    free = free.where(F.size("free") > 0).crossJoin(F.broadcast(counts)).select("u_idx", "free", F.transform("free", lambda j: F.element_at("_counts", j)).alias("n"))
    rows = pairs.select("u_idx", "i_idx").join(free, "u_idx")
    key = lambda j, n: -F.log(uniform_draw("u_idx", "i_idx", j, seed=seed) + 1e-12) / n
    keyed = F.zip_with("free", "n", lambda j, n: F.struct(key(j, n).alias("key"), j.alias("j_idx")))
    if per_pair == 1:
        return rows.select("u_idx", "i_idx", F.array_min(keyed)["j_idx"].alias("j_idx"))
    # sort_array compares in the type's own order, array_sort by calls of a function.
    return rows.select("u_idx", "i_idx", F.explode_outer(F.slice(F.sort_array(keyed), 1, per_pair)).alias("x")).select("u_idx", "i_idx", "x.j_idx")


def confidence_weights(rating: Column, confidence: Column, bonus: float = 1.5, penalty: float = 0.5, threshold: float = 4.5) -> Column:
    """1, raised for confident and lowered for suspicious positives."""
    return F.when((rating == 5) & (confidence < 5.3), penalty).when(confidence >= threshold, bonus).otherwise(1.0)


def project(df: DataFrame, vec: str, k: int) -> DataFrame:
    """df with the column `factors`: the first k principal components of its vectors."""
    ready = df.withColumn("_v", array_to_vector(vec))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready)
    return model.transform(ready).withColumn("factors", vector_to_array("_p")).drop("_v", "_p")


@dataclass
class Decomposition:
    """A truncated SVD of rows: the mean that was taken off (zeros if none), the right vectors (one a column), singular
    values, the share of the variance (or of the squares) that each explains, and the passes that it took."""

    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    passes: int

    def apply(self, df: DataFrame, vec: str, whiten: bool = False) -> DataFrame:
        """df with `factors`: its vectors' coordinates, divided by the singular values if `whiten`."""
        turn = self.vectors / np.maximum(self.values, 1e-12) if whiten else self.vectors
        mean = self.mean

        def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                rows = _rows(b.column(vec), len(mean)) - mean
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(rows @ turn), pa.list_(pa.float64()))], [*b.schema.names, "factors"])

        return df.mapInArrow(project, StructType([*df.schema.fields, StructField("factors", ArrayType(DoubleType()))]))


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def truncated_svd(df: DataFrame, vec: str, k: int, centre: bool = True, extra: int = 56, tolerance: float = 1e-10, most: int = 60, seed: int = 0) -> Decomposition:
    """The k largest singular values and right vectors by a randomised range finder with power iterations.

    A pass gives each partition's rows times a basis, and back times the rows: what meets is the sum of one small matrix
    a partition (dimensions by k + extra numbers), never rows or a square of the dimensions. Passes go on until no value
    moves by more than `tolerance` of the largest. Signs make each vector's largest entry positive. Null vectors count
    for nothing; k is cut to the dimensions, and a table without vectors is an error.
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL")
    first = rows.first()
    if first is None:
        raise ValueError("no vectors")
    size = len(first.v)
    k = min(k, size)

    def summed(f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of f(rows of a batch) over all batches, added up by place in Spark."""

        def parts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for b in it:
                total += f(_rows(b.column("v"), size))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "x"])

        found = rows.mapInArrow(parts, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").toArrow()
        return found["x"].to_numpy().reshape(shape)

    moments = summed(lambda m: np.concatenate([m.sum(axis=0), [(m * m).sum(), len(m)]]), (size + 2,))
    mean = moments[:size] / moments[-1] if centre else np.zeros(size)
    total = moments[-2] - moments[-1] * float(mean @ mean)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, min(size, k + extra))))[0]
    values, passes = None, 0
    while passes < most:
        back = summed(lambda m, basis=basis: (m - mean).T @ ((m - mean) @ basis), basis.shape)
        passes += 1
        # The basis turned to the directions in which the rows are longest.
        squares, turn = np.linalg.eigh(basis.T @ back)
        order = np.argsort(-squares)
        now = np.sqrt(np.maximum(squares[order], 0))[:k]
        vectors = basis @ turn[:, order[:k]]
        if values is not None and np.abs(now - values).max() <= tolerance * max(now[0], 1e-300) or basis.shape[1] == size:
            values = now
            break
        values, basis = now, np.linalg.qr(back)[0]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1, 1)
    return Decomposition(mean, vectors, values, values**2 / total if total > 0 else np.zeros(k), passes)


def initial_factors(ids: DataFrame, rank: int, scale: float = 0.01, seed: int = 0) -> DataFrame:
    """(id, features): normal draws by Box and Muller from hashes of the id, so they never change."""
    draw = lambda i, k: F.pmod(F.xxhash64("id", i, F.lit(k), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    normal = lambda i: scale * F.sqrt(-2 * F.log(draw(i, 0) + 1e-12)) * F.cos(2 * np.pi * draw(i, 1))
    return ids.select("id", F.transform(F.sequence(F.lit(1), F.lit(rank)), normal).alias("features"))
