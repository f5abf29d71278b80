"""Tests and drift checks: sufficient statistics are Spark aggregates; the driver only sees a few numbers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.ordered import running_totals


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's distribution."""
    half = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


def t_quantile(p: float, df: float) -> float:
    low, high = -1e3, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_tail(mid, df) < p else (low, mid)
    return (low + high) / 2


def paired_t(df: DataFrame, a: str, b: str, alternative: str = "two-sided") -> dict:
    """t, p, n and the mean difference; NaN for fewer than three pairs."""
    d = F.col(a) - F.col(b)
    n, mean, std = df.agg(F.count(d), F.avg(d), F.stddev_samp(d)).first()
    if n < 3 or not std:
        return {"n": n, "mean": mean, "t": math.nan, "p": math.nan}
    t = mean / (std / math.sqrt(n))
    upper = t_tail(t, n - 1)
    return {"n": n, "mean": mean, "t": t, "p": {"two-sided": 2 * min(upper, 1 - upper), "greater": upper, "less": 1 - upper}[alternative]}


def average_ranks(df: DataFrame, value: Column) -> DataFrame:
    """df with avg_rank: ties share their mean rank. Ranks come from running counts of distinct values."""
    counts = df.withColumn("_v", value).groupBy("_v").agg(F.count("*").alias("_n"))
    ranks = running_totals(counts, "_v", ["_n"]).select("_v", (F.col("run__n") - F.col("_n") + (F.col("_n") + 1) / 2).alias("avg_rank"))
    return df.withColumn("_v", value).join(ranks, "_v").drop("_v")


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w_plus, w_minus, z): zero differences dropped, normal approximation with tie-free variance."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    ranked = average_ranks(d, F.round(F.abs("d"), 9))
    row = ranked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("avg_rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("avg_rank")).otherwise(0.0)).alias("w_minus"))
    n = F.col("n")
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return row.withColumn("z", F.when(n >= 10, F.round(z, 6)))


def signed_ranks(n: int) -> np.ndarray:
    """The null distribution of a signed-rank sum of n untied differences: P(W = 0), P(W = 1), ... by convolution."""
    p = np.ones(1)
    for rank in range(1, n + 1):
        p = 0.5 * (np.concatenate([p, np.zeros(rank)]) + np.concatenate([np.zeros(rank), p]))
    return p


#: Differences up to which the distribution is exact, if none tie.
EXACT = 50


def wilcoxon_sums(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, w_plus, ties): non-zero differences, the rank sum of the positive ones, and the sum of t^3 - t over ties."""
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0")
    size = F.round(F.abs("d"), 9)
    row = average_ranks(d, size).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("avg_rank"))), F.lit(0.0)).alias("w_plus"))
    tied = d.groupBy(size.alias("m")).agg(F.count("*").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0)).alias("ties"))
    return row.crossJoin(tied)  # one row each


def wilcoxon_test(df: DataFrame, a: str, b: str, alternative: str = "two-sided") -> dict:
    """n, statistic and p of the signed-rank test; NaN for fewer than ten non-zero differences.

    The statistic is the smaller rank sum, or the positive one for a one-sided test. Up to EXACT differences without ties
    the distribution is exact; else it is normal, with the variance corrected for ties and no continuity correction.
    """
    n, plus, ties = wilcoxon_sums(df, a, b).first()
    whole = n * (n + 1) / 2
    statistic = min(plus, whole - plus) if alternative == "two-sided" else plus
    if n < 10:
        return {"n": n, "statistic": math.nan, "p": math.nan}
    if n <= EXACT and not ties:
        p = signed_ranks(n)
        upper, lower = float(p[round(plus) :].sum()), float(p[: round(plus) + 1].sum())
    else:
        z = (plus - whole / 2) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        upper, lower = NormalDist().cdf(-z), NormalDist().cdf(z)
    return {"n": n, "statistic": statistic, "p": {"two-sided": min(1.0, 2 * min(upper, lower)), "greater": upper, "less": lower}[alternative]}


def effect_sizes(df: DataFrame, a: str, b: str) -> DataFrame:
    """(paired_d, pooled_d, glass_delta)."""
    d = F.col(a) - F.col(b)
    row = df.agg(F.avg(d).alias("m"), F.stddev_samp(d).alias("s"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return row.select(*[F.round(F.when(s > 0, F.col("m") / s).otherwise(0.0), 6).alias(n) for n, s in (("paired_d", F.col("s")), ("pooled_d", pooled), ("glass_delta", F.sqrt("vb")))])


def confidence_interval(df: DataFrame, value: str, level: float = 0.95) -> tuple[float, float, float]:
    n, mean, std = df.agg(F.count(value), F.avg(value), F.stddev_samp(value)).first()
    half = t_quantile((1 + level) / 2, n - 1) * std / math.sqrt(n) if n > 1 else math.nan
    return mean, mean - half, mean + half


def corrected(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """df with bonferroni and holm: corrected p-values and step-down rejections. A family of tests is small."""
    m = F.count("*").over(Window.partitionBy())
    k = F.row_number().over(Window.orderBy(p))
    out = df.withColumns({"bonferroni_p": F.least(F.col(p) * m, F.lit(1.0)), "holm_p": F.least(F.col(p) * (m - k + 1), F.lit(1.0)), "_ok": (F.col(p) <= alpha / (m - k + 1)).cast("int")})
    step = F.min("_ok").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("holm_reject", step).drop("_ok")


def ks_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """(n_a, n_b, d): the largest distance of two empirical distributions, over counts of distinct values."""
    both = a.select(F.col(value).alias("x"), F.lit(1).alias("in_a")).unionByName(b.select(F.col(value).alias("x"), F.lit(0).alias("in_a"))).where("x is not null")
    steps = both.groupBy("x").agg(F.sum("in_a").alias("a"), F.sum(1 - F.col("in_a")).alias("b"))
    run = running_totals(steps, "x", ["a", "b"]).crossJoin(steps.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b")))
    return run.agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.round(F.max(F.abs(F.col("run_a") / F.col("n_a") - F.col("run_b") / F.col("n_b"))), 6).alias("d"))


def ks_p(d: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample statistic."""
    x = d * math.sqrt(n * m / (n + m))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_ranks(df.select(a, b), F.col(a)).withColumnRenamed("avg_rank", "_ra")
    ranked = average_ranks(ranked, F.col(b)).withColumnRenamed("avg_rank", "_rb")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("_ra", "_rb"), 6).alias("rho"))


def _bits(h: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Mixed 64-bit numbers of each row's hash and each replicate (splitmix64)."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64)[:, None] + (np.arange(1, replicates + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _replicate_sums(rows: DataFrame, replicates: int, seed: int, weight: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(r, s, w): for each replicate the weighted sum of rows (v, h) and the sum of the weights, which come from bits of
    each row's hash. A partition keeps running sums of the replicates, so a row is never multiplied."""

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, w = np.zeros(replicates), np.zeros(replicates)
        for b in it:
            v, h = b.column("v").to_numpy(zero_copy_only=False), b.column("h").to_numpy()
            for at in range(0, len(v), 4096):
                own = weight(_bits(h[at : at + 4096], replicates, seed)).astype(float)
                s, w = s + v[at : at + 4096] @ own, w + own.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates, dtype=np.int32)), pa.array(s), pa.array(w)], ["r", "s", "w"])

    found = rows.where("v IS NOT NULL").mapInArrow(sums, "r int, s double, w double")
    return found.groupBy("r").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def bootstrap(df: DataFrame, value: str, replicates: int = 200, level: float = 0.95, seed: int = 7, key: str | None = None) -> DataFrame:
    """(low, high): percentile interval of the mean. Each row has a Poisson(1) weight in each replicate, from a hash of its
    key (of all its values without one), so a task that runs again draws the same."""
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])
    rows = df.select(F.col(value).cast("double").alias("v"), F.xxhash64(*([key] if key else df.columns)).alias("h"))
    found = _replicate_sums(rows, replicates, seed, lambda bits: np.searchsorted(steps, ((bits >> np.uint64(11)) + 0.5) / float(1 << 53)))
    means = found.where("w > 0").select((F.col("s") / F.col("w")).alias("m"))
    return means.agg(*[F.percentile("m", F.lit(q)).alias(n) for n, q in (("low", (1 - level) / 2), ("high", (1 + level) / 2))])


def permutation_p(df: DataFrame, a: str, b: str, replicates: int = 500, seed: int = 7, key: str | None = None) -> DataFrame:
    """(observed, p): sign flips of paired differences, from a hash of the key, or of all values."""
    rows = df.select((F.col(a) - F.col(b)).cast("double").alias("v"), F.xxhash64(*([key] if key else df.columns)).alias("h"))
    flips = _replicate_sums(rows, replicates, seed, lambda bits: 1 - 2 * (bits >> np.uint64(63)).astype(np.int8))
    observed = rows.agg(F.sum("v").alias("total"), F.count("v").alias("n"))
    return flips.crossJoin(observed).agg((F.first("total") / F.first("n")).alias("observed"), ((F.count_if(F.abs("s") >= F.abs("total") - 1e-9 * F.abs("total")) + 1) / (F.count("*") + 1)).alias("p"))


def activity_drift(old: DataFrame, new: DataFrame, limit: float = 0.2) -> DataFrame:
    """(old_mean, new_mean, change, drift, returned, brand_new) of rows a user."""
    a, b = (x.groupBy("user_id").agg(F.count("*").alias(n)) for x, n in ((old, "old"), (new, "new")))
    both = a.join(b, "user_id", "full_outer")
    row = both.agg(F.avg("old").alias("old_mean"), F.avg("new").alias("new_mean"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("returned"), F.count_if(F.col("old").isNull()).alias("brand_new"))
    change = F.abs(F.col("new_mean") - F.col("old_mean")) / F.col("old_mean")
    return row.select(F.round("old_mean", 6).alias("old_mean"), F.round("new_mean", 6).alias("new_mean"), F.round(change, 6).alias("change"), (change > limit).cast("int").alias("drift"), "returned", "brand_new")


def normality(df: DataFrame, value: str) -> DataFrame:
    """(n, skew, excess_kurtosis, jarque_bera) from population moments; a substitute for order-statistic tests, which need
    a global sort."""
    r = df.agg(F.count(value).alias("n"), F.skewness(value).alias("s"), F.kurtosis(value).alias("k"))
    jb = F.col("n") / 6 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    return r.select("n", F.round("s", 6).alias("skew"), F.round("k", 6).alias("excess_kurtosis"), F.round(jb, 5).alias("jarque_bera"))


def shapiro_wilk(df: DataFrame, value: str, key: str | None = None, most: int = 5000) -> tuple[int, float, float]:
    """(n, W, p) of the Shapiro-Wilk test, by Royston's approximation, on at most `most` rows, those of the smallest hash
    of their key. Under three values, or equal ones: (n, nan, nan)."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.xxhash64(key or value).alias("h"))
    x = np.sort(np.array([r[0] for r in rows.orderBy("h", "v").limit(most).collect()]))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return n, math.nan, math.nan
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    square, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(square)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
        if n > 5:
            before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
            phi = (square - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a = m / math.sqrt(phi)
            a[-2], a[1] = before, -before
        else:
            a = m / math.sqrt((square - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return n, w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return n, 1.0, 1.0
    size = math.log(n)
    if n < 12:
        g, mean = -2.273 + 0.459 * n, np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        deviation, at = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n)), math.log(1 - w)
        if at >= g:
            return n, w, 0.0
        at = -math.log(g - at)
    else:
        mean, deviation = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], size), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], size))
        at = math.log(1 - w)
    return n, w, 1 - NormalDist().cdf((at - mean) / deviation)


def compare_models(df: DataFrame, model: str, a: str, b: str) -> DataFrame:
    """(model, n, t, d) of paired differences a - b for each model; few rows, ready for corrected()."""
    d = F.col(a) - F.col(b)
    r = df.groupBy(model).agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s"))
    return r.select(model, "n", F.round(F.col("m") / (F.col("s") / F.sqrt("n")), 6).alias("t"), F.round(F.col("m") / F.col("s"), 6).alias("d"))


def compare_corrected(df: DataFrame, model: str, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """compare_models() with the one-sided p of each model's t (a greater than b), and Bonferroni's and Holm's corrections
    over the family of models, one row each."""
    rows = compare_models(df, model, a, b)
    found = [(*r, t_tail(r.t, r.n - 1) if r.n > 2 and r.t is not None else None) for r in rows.collect()]
    kind = dict(rows.dtypes)[model]
    return corrected(df.sparkSession.createDataFrame(found, f"{model} {kind}, n long, t double, d double, p double").where("p IS NOT NULL"), "p", alpha)
