"""Ranking metrics over recommendation lists.

recs: (user_id, item, rank) from rank 1; truth: (user_id, item) relevant pairs. Lists are sets of rows, so every metric
is a join of the two and one aggregate by user; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(user_id, n_truth, n_recs, hits, first_hit, dcg, ap_sum) for each user with a truth; n_recs counts ranks up to k."""
    top = recs.where(F.col("rank") <= k).select("user_id", "item", "rank")
    true = truth.select("user_id", "item").distinct().withColumn("hit", F.lit(1))
    marked = top.join(true, ["user_id", "item"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    run = F.sum("hit").over(Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("run", run)
    per = marked.groupBy("user_id").agg(
        F.count("*").alias("n_recs"), F.sum("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("hit") == 1, F.col("run") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
    )
    sizes = truth.select("user_id", "item").distinct().groupBy("user_id").agg(F.count("*").alias("n_truth"))
    zero = {"n_recs": 0, "hits": 0, "dcg": 0.0, "ap_sum": 0.0}
    return sizes.join(per, "user_id", "left").na.fill(zero)


def _ideal(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


#: Metrics as expressions over hits(); `k` is the list length.
METRICS: dict[str, Callable[[int], Column]] = {
    "recall": lambda k: _share(F.col("hits"), F.col("n_truth")),
    "recall_capped": lambda k: _share(F.col("hits"), F.least("n_truth", F.lit(k))),
    "precision": lambda k: _share(F.col("hits"), F.least(F.lit(k), F.col("n_recs"))),
    "ndcg": lambda k: F.when(F.col("n_recs") > 0, F.col("dcg") / _ideal(F.least("n_truth", "n_recs", F.lit(k)))).otherwise(0.0),
    "ndcg_full": lambda k: F.col("dcg") / _ideal(F.least("n_truth", F.lit(k))),
    "mrr": lambda k: F.when(F.col("first_hit").isNotNull(), 1 / F.col("first_hit")).otherwise(0.0),
    "map": lambda k: _share(F.col("ap_sum"), F.least("n_truth", F.lit(k))),
    "hit_rate": lambda k: (F.col("hits") > 0).cast("double"),
}


def per_user(recs: DataFrame, truth: DataFrame, k: int, names: list[str] | None = None) -> DataFrame:
    """(user_id and each metric)."""
    return hits(recs, truth, k).select("user_id", *[METRICS[n](k).alias(n) for n in names or METRICS])


def at_k(name: str, recs: DataFrame, truth: DataFrame, k: int) -> float:
    """One metric's mean over users; ValueError for a name that isn't in METRICS."""
    if name not in METRICS:
        raise ValueError(f"{name}: one of {sorted(METRICS)}")
    return per_user(recs, truth, k, [name]).agg(F.avg(name)).first()[0] or 0.0


def summary(per: DataFrame, names: list[str]) -> DataFrame:
    """(metric, mean, std): population deviation over users."""
    row = per.agg(*[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")).alias(n) for n in names])
    each = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("x"))
    return each.select("x.metric", F.round("x.v.mean", 6).alias("mean"), F.round("x.v.std", 6).alias("std"))


def stratified(per: DataFrame, activity: DataFrame, names: list[str]) -> DataFrame:
    """Means by a user's number of interactions: 2 to 4, 5 to 9, 10 to 49, 50 and more."""
    n = F.col("n")
    bin_ = F.when(n < 2, "<2").when(n < 5, "2-4").when(n < 10, "5-9").when(n < 50, "10-49").otherwise("50+")
    return per.join(activity, "user_id").groupBy(bin_.alias("bin")).agg(F.count("*").alias("users"), *[F.round(F.avg(m), 6).alias(m) for m in names])


def coverage(recs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(recommended, total, coverage)."""
    got = recs.where(F.col("rank") <= k).agg(F.count_distinct("item").alias("recommended"))
    return got.crossJoin(items.agg(F.count_distinct("item").alias("total"))).withColumn("coverage", F.round(_share(F.col("recommended"), F.col("total")), 6))


def cold_coverage(recs: DataFrame, cold: DataFrame, k: int) -> DataFrame:
    got = recs.where(F.col("rank") <= k).join(cold.select("item").distinct(), "item", "left_semi").agg(F.count_distinct("item").alias("recommended"))
    return got.crossJoin(cold.agg(F.count_distinct("item").alias("total"))).withColumn("coverage", F.round(_share(F.col("recommended"), F.col("total")), 6))


def novelty(recs: DataFrame, popularity: DataFrame, total: int | Column, k: int) -> DataFrame:
    """(user_id, novelty): mean log2(N / pop) over the list's items with a popularity."""
    n = F.lit(total) if isinstance(total, int) else total
    rows = recs.where(F.col("rank") <= k).join(popularity.where("n > 0"), "item")
    return rows.groupBy("user_id").agg(F.round(F.avg(F.log2(n / F.col("n"))), 6).alias("novelty"))


def serendipity(recs: DataFrame, truth: DataFrame, baseline: DataFrame, k: int) -> DataFrame:
    """(user_id, serendipity): relevant items that the baseline's top k doesn't hold, over k."""
    keys = ["user_id", "item"]
    good = recs.where(F.col("rank") <= k).join(truth.select(*keys).distinct(), keys, "left_semi").join(baseline.where(F.col("rank") <= k).select(*keys), keys, "left_anti")
    n = good.groupBy("user_id").agg(F.count("*").alias("n"))
    return truth.select("user_id").distinct().join(n, "user_id", "left").select("user_id", F.round(F.coalesce("n", F.lit(0)) / k, 6).alias("serendipity"))


def improvement(model: DataFrame, baseline: DataFrame) -> DataFrame:
    """Absolute and relative improvement of (metric, mean) rows over a baseline's."""
    both = model.select("metric", F.col("mean").alias("model")).join(baseline.select("metric", F.col("mean").alias("baseline")), "metric")
    gain = F.col("model") - F.col("baseline")
    return both.select("metric", "model", "baseline", F.round(gain, 6).alias("gain"), F.round(F.when(F.col("baseline") != 0, 100 * gain / F.col("baseline")), 4).alias("gain_pct"))
