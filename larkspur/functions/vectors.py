"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its norm, which is taken once, not once an element; a zero vector stays as it is."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def pooled(df: DataFrame, key: str, vec: str, how: str = "mean", weight: str | None = None) -> DataFrame:
    """(key, vec): element-wise mean, weighted mean or maximum of a key's vectors, as partial aggregates over positions."""
    at = df.select(key, *([weight] if weight else []), F.posexplode(vec).alias("_p", "_x"))
    if how == "max":
        value = F.max("_x")
    elif weight:
        value = F.when(F.sum(weight) != 0, F.sum(F.col("_x") * F.col(weight)) / F.sum(weight)).otherwise(F.avg("_x"))
    else:
        value = F.avg("_x")
    each = at.groupBy(key, "_p").agg(value.alias("_v"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "_v"))).alias("_l")).select(key, F.transform("_l", lambda x: x["_v"]).alias(vec))
