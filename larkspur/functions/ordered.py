"""Running totals in the order of a number, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.shared import held

#: Rows of a range, on average: what one task sorts and sums.
RANGE_ROWS, MOST_RANGES = 500_000, 4096


def running_totals(df: DataFrame, key: str, sums: list[str], buckets: int | None = None) -> DataFrame:
    """df with run_<c> for each c: the sum of c over all rows whose key is at most the row's (ties: by row order).

    Rows are cut into ranges of the key at approximate quantiles, about RANGE_ROWS rows each, of which the driver holds
    as many numbers; each range is summed in order, and a range starts from the totals of those before it. Few rows are
    one range.
    """
    df = held(df)
    buckets = buckets or min(max(-(-df.count() // RANGE_ROWS), 1), MOST_RANGES)
    if buckets == 1:
        inside = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"run_{c}": F.sum(c).over(inside) for c in sums})
    bounds = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], min(0.002, 0.1 / buckets))))
    cuts = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    rows = df.withColumn("_b", F.size(F.filter(cuts, lambda c: c < F.col(key))))
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # At most `buckets` rows.
    totals = rows.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    starts = totals.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in sums])
    out = rows.join(F.broadcast(starts), "_b").withColumns({f"run_{c}": F.sum(c).over(inside) + F.col(f"_s_{c}") for c in sums})
    return out.drop("_b", *[f"_s_{c}" for c in sums])
