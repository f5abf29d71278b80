"""Users, items, mappings, matrices and temporal splits of interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.ordered import running_totals
from larkspur.operators.ranking import unseen_of


def user_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("is_positive").alias("positives"), F.sum(1 - F.col("is_positive")).alias("negatives"), F.avg("rating").alias("mean_rating")
    )


def trainable_users(df: DataFrame, least: int = 2, positives: int = 1) -> DataFrame:
    """user_stats with is_trainable: enough rows and positives."""
    return user_stats(df).withColumn("is_trainable", ((F.col("n") >= least) & (F.col("positives") >= positives)).cast("int"))


def with_trainable(df: DataFrame, **limits) -> DataFrame:
    return df.join(trainable_users(df, **limits).select("user_id", "is_trainable"), "user_id", "left")


def item_positive_counts(df: DataFrame) -> DataFrame:
    """Positives of trainable users by item; items without any don't appear."""
    return df.where("is_trainable = 1 AND is_positive = 1").groupBy("product_id").agg(F.count("*").alias("pos"))


def drop_rare_items(df: DataFrame, least: int = 5) -> DataFrame:
    """Rows without items of 1 to least-1 trainable positives. Items with none stay: they are never counted."""
    rare = item_positive_counts(df).where(F.col("pos") < least).select("product_id")
    return df.join(rare, "product_id", "left_anti")


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): 0, 1, ... in key order over distinct numeric keys; nulls have none. No task sees every key."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn("one", F.lit(1))
    return running_totals(keys, key, ["one"]).select(key, (F.col("run_one") - 1).cast("int").alias(name))


def index_violations(mapping: DataFrame, idx: str) -> DataFrame:
    return mapping.agg(F.count("*").alias("n"), F.min(idx).alias("first"), F.max(idx).alias("last"), F.count_distinct(idx).alias("distinct"))


def confidence_matrix(df: DataFrame, value: str) -> DataFrame:
    """Coordinates with repeated cells summed."""
    return df.groupBy("u_idx", "i_idx").agg(F.sum(value).alias("value"))


def matrix_stats(matrix: DataFrame, users: int | None = None, items: int | None = None) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    row = matrix.agg(F.count("*").alias("nnz"), F.count_distinct("u_idx").alias("users"), F.count_distinct("i_idx").alias("items"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), q.alias("q"))
    density = F.col("nnz") / (F.col("users") * F.col("items"))
    return row.select("nnz", "users", "items", F.round(density, 9).alias("density"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), *[F.round(F.col("q")[i], 6).alias(f"q{25 * (i + 1)}") for i in range(3)])


def popularity(df: DataFrame, items: DataFrame, key: str = "product_id") -> DataFrame:
    """(item, n, log_n) for every item of a domain, zero where it has no rows."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return items.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).withColumn("log_n", F.log1p("n"))


def top_popular(df: DataFrame, k: int = 50, key: str = "product_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def implicit_negatives(df: DataFrame, k: int = 50) -> DataFrame:
    """(user_id, product_id): popular items that a user hasn't touched. The popular side has k rows, a parameter."""
    free = unseen_of(top_popular(df, k), df, df)
    return free.select("user_id", F.explode("free").alias("product_id"))


def hard_negatives(df: DataFrame, k: int = 50) -> DataFrame:
    """(user_id, product_id, source): explicit low ratings and popular unseen items."""
    explicit = df.where("rating <= 3").select("user_id", "product_id").distinct().withColumn("source", F.lit("explicit"))
    return explicit.unionByName(implicit_negatives(df, k).withColumn("source", F.lit("implicit")))


def temporal_split(df: DataFrame, use_validation: bool = False, tie: str = "rid") -> DataFrame:
    """df with split (train, val, test or null: discarded) and holdout_type.

    A user's last positive is the test row; with validation the one before is held out as well, and users with one
    positive have no test row. Train is strictly before the first held-out row; rows at or after it are discarded.
    """
    # Held-out rows by partial aggregates, and one join to the rows by user: a user's rows are never gathered.
    late = F.coalesce(-F.unix_micros(F.col("ts").cast("timestamp")), F.lit((1 << 63) - 1))
    first = F.min(F.struct(late.alias("late"), "rating", F.col(tie).alias("tie"), "ts"))
    positives = df.where("is_positive = 1").select("user_id", "ts", "rating", tie)
    held = positives.groupBy("user_id").agg(first.alias("_test"), F.count("*").alias("_n"))
    if use_validation:
        held = held.where("_n >= 2")
        others = positives.join(held.select("user_id", F.col("_test.tie").alias("_t")), "user_id").where(F.col(tie) != F.col("_t"))
        held = held.join(others.groupBy("user_id").agg(first.alias("_val")), "user_id")
    else:
        held = held.withColumn("_val", F.lit(None).cast(held.schema["_test"].dataType))
    held = held.select("user_id", "_test", "_val", F.least("_test.ts", "_val.ts").alias("_cut"))
    split = F.when(F.col(tie) == F.col("_test.tie"), "test").when(F.col(tie) == F.col("_val.tie"), "val")
    out = df.join(held, "user_id", "left").withColumn("split", split)
    train = F.col("split").isNull() & (F.col("_test").isNull() | (F.col("ts") < F.col("_cut")))
    kind = F.when(F.col("split") == "test", "positive").when(F.col("split") == "val", "validation")
    return out.withColumn("split", F.when(train, "train").otherwise(F.col("split"))).withColumn("holdout_type", kind).drop("_test", "_val", "_cut")


def negative_holdout(df: DataFrame, held: DataFrame, tie: str = "rid") -> DataFrame:
    """Each test user's latest hard negative that isn't held out already."""
    users = held.where("split = 'test'").select("user_id").distinct()
    rows = df.where("rating <= 3").join(users, "user_id", "left_semi").join(held.where("split in ('test', 'val')").select(tie), tie, "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("rating").asc(), F.col(tie).asc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def implicit_holdout(df: DataFrame, users: DataFrame, n: int = 4, pool: int = 500) -> DataFrame:
    """(user_id, product_id, k): each user's first n unseen items of the popularity-ordered pool."""
    free = unseen_of(top_popular(df, pool), users, df)
    return free.select("user_id", F.posexplode(F.slice("free", 1, n)).alias("k", "product_id")).select("user_id", "product_id", (F.col("k") + 1).alias("k"))


def order_violations(split: DataFrame) -> DataFrame:
    """Users whose first test row isn't after their last train row."""
    t = split.groupBy("user_id").agg(F.min(F.when(F.col("split") == "test", F.col("ts"))).alias("t"), F.max(F.when(F.col("split") == "train", F.col("ts"))).alias("l"))
    return t.agg(F.count_if(F.col("t") < F.col("l")).alias("violations"), F.count("t").alias("test_users"))
