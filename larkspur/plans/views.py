"""The domain's tables over the driver's test tables: a DataFrame and the same as a SQL common table expression.

interactions: order lines as reviews; products: parts; requests: events; vectors: embeddings. Ties are frequent in
these data, so every ordering ends with `rid` or another unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import table

INTER = """inter AS (SELECT o_custkey AS user_id, l_partkey AS product_id, CAST(1 + ((CAST(l_quantity AS INTEGER) - 1) % 5) AS DOUBLE) AS rating,
  o_orderdate AS ts, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS rid, l_discount * 10 AS quality FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DEDUP = INTER + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC NULLS LAST, rating DESC NULLS LAST, rid) AS rn FROM inter),
dedup AS (SELECT user_id, product_id, rating, ts, rid, quality, CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS is_positive FROM ranked WHERE rn = 1)"""
PRODUCTS = """products AS (SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS category, p_retailprice AS price,
  coalesce(s.num_sold, 0) AS num_sold, s.avg_star FROM part LEFT JOIN (SELECT l_partkey, count(*) AS num_sold,
  avg(CAST(1 + ((CAST(l_quantity AS INTEGER) - 1) % 5) AS DOUBLE)) AS avg_star FROM lineitem GROUP BY l_partkey) s ON l_partkey = p_partkey)"""
REQUESTS = """requests AS (SELECT event_id, ts, user_id, abs(value) AS latency_ms, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS fallback,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed, event_type FROM events)"""


def interactions(spark, sf_dir) -> DataFrame:
    rating = (1 + ((F.col("l_quantity").cast("int") - 1) % 5)).cast("double")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product_id"), rating.alias("rating"), (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("rid"), (F.col("l_discount") * 10).alias("quality"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"))
    return lines.join(orders, "l_orderkey").select("user_id", "product_id", "rating", "ts", "rid", "quality")


def clean_interactions(spark, sf_dir) -> DataFrame:
    from larkspur.operators.cleaning import dedup_latest, label_flags

    return label_flags(dedup_latest(interactions(spark, sf_dir), ["user_id", "product_id"], "ts", "rating", "rid")).drop("is_hard_negative")


def products(spark, sf_dir) -> DataFrame:
    rating = (1 + ((F.col("l_quantity").cast("int") - 1) % 5)).cast("double")
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.count("*").alias("num_sold"), F.avg(rating).alias("avg_star"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))
    return part.join(sold, "product_id", "left").withColumn("num_sold", F.coalesce("num_sold", F.lit(0)))


def requests(spark, sf_dir) -> DataFrame:
    flag = lambda kind: (F.col("event_type") == kind).cast("int")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.abs("value").alias("latency_ms"), flag("view").alias("fallback"), flag("error").alias("failed"), "event_type")


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
