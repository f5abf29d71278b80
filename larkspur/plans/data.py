"""Queries of the data layer: scans, cleaning, users and items, matrices, splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import cleaning as C
from larkspur.operators import users_items as U
from larkspur.plans import views as V
from larkspur.plans.registry import query
from larkspur.session import table
from larkspur.sources.shared import held

RAW = V.INTER + """, raw AS (SELECT rid, CASE WHEN rid % 17 = 0 THEN 'bad' WHEN rid % 13 = 0 THEN concat(CAST(user_id AS VARCHAR), '.0') ELSE CAST(user_id AS VARCHAR) END AS user_id,
  CAST(product_id AS VARCHAR) AS product_id, CASE WHEN rid % 19 = 0 THEN NULL WHEN rid % 23 = 0 THEN 'n/a' WHEN rid % 29 = 0 THEN '6' ELSE CAST(CAST(rating AS INTEGER) AS VARCHAR) END AS rating,
  CASE rid % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y') WHEN 2 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%d-%m-%Y') END AS ts FROM inter)"""
_DATE = "coalesce(try_strptime(ts, '%Y-%m-%d %H:%M:%S'), try_strptime(ts, '%d/%m/%Y'), try_strptime(ts, '%Y-%m-%d'), try_strptime(ts, '%d-%m-%Y'))"
_LONG = "TRY_CAST(TRY_CAST({0} AS DOUBLE) AS BIGINT)"


def raw(spark, sf_dir):
    """Interactions as dirty text: bad and decimal ids, missing and bad ratings, four date formats."""
    x, rid = V.interactions(spark, sf_dir), F.col("rid")
    user, rating = F.col("user_id").cast("string"), F.col("rating").cast("int").cast("string")
    fmt = lambda f: F.date_format("ts", f)
    date = F.when(rid % 4 == 0, fmt(C.DATE_FORMATS[0])).when(rid % 4 == 1, fmt(C.DATE_FORMATS[1])).when(rid % 4 == 2, fmt(C.DATE_FORMATS[2])).otherwise(fmt(C.DATE_FORMATS[3]))
    return x.select(
        "rid", F.when(rid % 17 == 0, "bad").when(rid % 13 == 0, F.concat(user, F.lit(".0"))).otherwise(user).alias("user_id"), F.col("product_id").cast("string").alias("product_id"),
        F.when(rid % 19 == 0, F.lit(None)).when(rid % 23 == 0, "n/a").when(rid % 29 == 0, "6").otherwise(rating).alias("rating"), date.alias("ts"),
    )


@query("s4_projected_scan", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def s4(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_quantity")


@query("s5_metadata_scan", f"WITH {V.PRODUCTS} SELECT product_id, product_name, brand, category, price, num_sold, round(avg_star, 6) AS avg_star FROM products")
def s5(spark, d):
    return V.products(spark, d).withColumn("avg_star", F.round("avg_star", 6))


@query("f1_coerce_int", f"WITH {RAW} SELECT rid, {_LONG.format('user_id')} AS user_id FROM raw WHERE {_LONG.format('user_id')} IS NOT NULL")
def f1(spark, d):
    return C.coerce(raw(spark, d), ["user_id"]).select("rid", "user_id")


@query("f2_coerce_float", f"WITH {RAW} SELECT rid, TRY_CAST(rating AS DOUBLE) AS rating FROM raw WHERE TRY_CAST(rating AS DOUBLE) IS NOT NULL")
def f2(spark, d):
    return C.coerce(raw(spark, d), doubles=["rating"]).select("rid", "rating")


@query("f3_parse_dates", f"WITH {RAW} SELECT rid, {_DATE} AS ts FROM raw")
def f3(spark, d):
    return C.parse_dates(raw(spark, d), "ts").select("rid", "ts")


@query("f3_parse_dates_one_format", f"WITH {RAW} SELECT rid, try_strptime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM raw")
def f3b(spark, d):
    return C.parse_dates(raw(spark, d), "ts", "column").select("rid", "ts")


@query(
    "f4_coercion_losses",
    f"""WITH {RAW} SELECT 'user_id' AS "column", count(*) FILTER (WHERE user_id IS NULL) AS missing, count(*) FILTER (WHERE user_id IS NOT NULL AND {_LONG.format("user_id")} IS NULL) AS unparsable FROM raw
UNION ALL SELECT 'rating', count(*) FILTER (WHERE rating IS NULL), count(*) FILTER (WHERE rating IS NOT NULL AND TRY_CAST(rating AS DOUBLE) IS NULL) FROM raw""",
)
def f4(spark, d):
    return C.coercion_losses(raw(spark, d), ["user_id"], ["rating"])


@query("f5_rating_range", f"WITH {RAW} SELECT rid, rating FROM (SELECT rid, TRY_CAST(rating AS DOUBLE) AS rating FROM raw) WHERE rating BETWEEN 1 AND 5")
def f5(spark, d):
    return C.in_range(C.coerce(raw(spark, d), doubles=["rating"]), "rating", 1, 5).select("rid", "rating")


@query(
    "f7_validate",
    f"""WITH {RAW} SELECT * FROM (SELECT rid, {_LONG.format("user_id")} AS user_id, {_LONG.format("product_id")} AS product_id, TRY_CAST(rating AS DOUBLE) AS rating, {_DATE} AS ts FROM raw)
WHERE user_id IS NOT NULL AND product_id IS NOT NULL AND ts IS NOT NULL AND rating BETWEEN 1 AND 5""",
)
def f7(spark, d):
    return C.validate(raw(spark, d))


@query(
    "f6_retention_stats",
    f"""WITH {RAW}, v AS (SELECT * FROM raw WHERE {_LONG.format("user_id")} IS NOT NULL AND TRY_CAST(rating AS DOUBLE) BETWEEN 1 AND 5 AND {_DATE} IS NOT NULL)
SELECT (SELECT count(*) FROM raw) AS before, (SELECT count(*) FROM v) AS after, round((SELECT count(*) FROM v) / (SELECT count(*) FROM raw), 6) AS kept""",
)
def f6(spark, d):
    x = raw(spark, d)
    n = x.agg(F.count("*").alias("before")).crossJoin(C.validate(x).agg(F.count("*").alias("after")))
    return n.withColumn("kept", F.round(F.col("after") / F.col("before"), 6))


@query("f8_label_flags", f"WITH {V.INTER} SELECT rid, CASE WHEN rating >= 4 THEN 1 ELSE 0 END AS is_positive, CASE WHEN rating <= 3 THEN 1 ELSE 0 END AS is_hard_negative FROM inter")
def f8(spark, d):
    return C.label_flags(V.interactions(spark, d)).select("rid", "is_positive", "is_hard_negative")


@query("f9_label_invariants", "SELECT CAST(0 AS BIGINT) AS both, CAST(0 AS BIGINT) AS wrong_positive")
def f9(spark, d):
    return C.label_violations(C.label_flags(V.interactions(spark, d)))


@query("f18_null_safe_diff", f"""WITH {RAW} SELECT 'rating' AS "column", count(*) FILTER (WHERE r.rating IS DISTINCT FROM CAST(CAST(i.rating AS INTEGER) AS VARCHAR)) AS changed FROM raw r JOIN inter i USING (rid)""")
def f18(spark, d):
    clean = V.interactions(spark, d).select("rid", F.col("rating").cast("int").cast("string").alias("rating"))
    return C.text_diff(raw(spark, d).select("rid", "rating"), clean, "rid", ["rating"])


@query("f20_missing_report", f"""WITH {RAW} SELECT 'rid' AS "column", CAST(0 AS BIGINT) AS missing UNION ALL SELECT 'user_id', count(*) FILTER (WHERE user_id IS NULL) FROM raw UNION ALL SELECT 'product_id', count(*) FILTER (WHERE product_id IS NULL) FROM raw
UNION ALL SELECT 'rating', count(*) FILTER (WHERE rating IS NULL) FROM raw UNION ALL SELECT 'ts', count(*) FILTER (WHERE ts IS NULL) FROM raw""")
def f20(spark, d):
    return C.missing_report(raw(spark, d))


@query("f20_rating_distribution", f"WITH {V.INTER} SELECT rating, count(*) AS n FROM inter GROUP BY rating")
def f20b(spark, d):
    return V.interactions(spark, d).groupBy("rating").agg(F.count("*").alias("n"))


@query("w1_dedup_latest", f"WITH {V.DEDUP} SELECT rid, user_id, product_id, rating, ts FROM dedup")
def w1(spark, d):
    return V.clean_interactions(spark, d).select("rid", "user_id", "product_id", "rating", "ts")


@query("a8_duplicate_stats", f"WITH {V.INTER} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows, count(*) AS duplicate_groups FROM (SELECT count(*) AS n FROM inter GROUP BY user_id, product_id HAVING count(*) > 1)")
def a8(spark, d):
    return C.duplicate_stats(V.interactions(spark, d), ["user_id", "product_id"])


@query("a1_user_stats", f"WITH {V.DEDUP} SELECT user_id, count(*) AS n, CAST(sum(is_positive) AS BIGINT) AS positives, CAST(sum(1 - is_positive) AS BIGINT) AS negatives, round(avg(rating), 6) AS mean_rating FROM dedup GROUP BY user_id")
def a1(spark, d):
    return U.user_stats(V.clean_interactions(spark, d)).withColumn("mean_rating", F.round("mean_rating", 6))


_TRAIN = V.DEDUP + """, st AS (SELECT user_id, CASE WHEN count(*) >= 2 AND sum(is_positive) >= 1 THEN 1 ELSE 0 END AS is_trainable FROM dedup GROUP BY user_id),
tr AS (SELECT d.*, st.is_trainable FROM dedup d LEFT JOIN st USING (user_id))"""


@query("a2_user_segmentation", f"WITH {_TRAIN} SELECT is_trainable, count(*) AS users FROM st GROUP BY is_trainable")
def a2(spark, d):
    return U.trainable_users(V.clean_interactions(spark, d)).groupBy("is_trainable").agg(F.count("*").alias("users"))


@query("j1_attach_trainable", f"WITH {_TRAIN} SELECT rid, is_trainable FROM tr")
def j1(spark, d):
    return U.with_trainable(V.clean_interactions(spark, d)).select("rid", "is_trainable")


@query("f10_trainable_only", f"WITH {_TRAIN} SELECT rid, user_id FROM tr WHERE is_trainable = 1")
def f10(spark, d):
    return U.with_trainable(V.clean_interactions(spark, d)).where("is_trainable = 1").select("rid", "user_id")


@query("a3_item_positive_counts", f"WITH {_TRAIN} SELECT product_id, count(*) AS pos FROM tr WHERE is_trainable = 1 AND is_positive = 1 GROUP BY product_id")
def a3(spark, d):
    return U.item_positive_counts(U.with_trainable(V.clean_interactions(spark, d)))


@query("a4_filter_rare_items", f"WITH {_TRAIN}, c AS (SELECT product_id, count(*) AS pos FROM tr WHERE is_trainable = 1 AND is_positive = 1 GROUP BY product_id) SELECT rid FROM tr WHERE product_id NOT IN (SELECT product_id FROM c WHERE pos < 10)")
def a4(spark, d):
    return U.drop_rare_items(U.with_trainable(V.clean_interactions(spark, d)), 10).select("rid")


@query(
    "a7_outlier_report",
    f"""WITH {V.INTER}, c AS (SELECT user_id, count(*) AS n FROM inter GROUP BY user_id), s AS (SELECT max(n) > 0.9 * sum(n) AS biased FROM (SELECT rating, count(*) AS n FROM inter GROUP BY rating))
SELECT count(*) FILTER (WHERE n > 60) AS heavy, count(*) FILTER (WHERE n < 20) AS cold, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS most, min(n) AS least, CAST(any_value(biased) AS INTEGER) AS biased FROM c, s""",
)
def a7(spark, d):
    return C.outlier_report(V.interactions(spark, d), "user_id", most=60, least=20)


@query(
    "a9_quality_buckets",
    f"""WITH {V.INTER} SELECT count(*) FILTER (WHERE quality = 0) AS zero, count(*) FILTER (WHERE quality > 0 AND quality <= 0.2) AS low, count(*) FILTER (WHERE quality > 0.2 AND quality <= 0.5) AS mid, count(*) FILTER (WHERE quality > 0.5) AS high,
round(avg(quality), 6) AS mean, round(stddev_samp(quality), 6) AS std, round(quantile_cont(quality, 0.25), 6) AS p25, round(quantile_cont(quality, 0.75), 6) AS p75 FROM inter""",
)
def a9(spark, d):
    q = F.col("quality")
    row = V.interactions(spark, d).agg(
        F.count_if(q == 0).alias("zero"), F.count_if((q > 0) & (q <= 0.2)).alias("low"), F.count_if((q > 0.2) & (q <= 0.5)).alias("mid"), F.count_if(q > 0.5).alias("high"),
        F.avg(q).alias("mean"), F.stddev_samp(q).alias("std"), F.percentile(q, F.array(F.lit(0.25), F.lit(0.75))).alias("p"),
    )
    return row.select("zero", "low", "mid", "high", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(F.col("p")[0], 6).alias("p25"), F.round(F.col("p")[1], 6).alias("p75"))


@query(
    "a10_confidence_by_rating",
    f"WITH {V.INTER} SELECT rating, count(*) AS n, round(avg(rating + quality), 6) AS mean, round(quantile_cont(rating + quality, 0.5), 6) AS median, round(stddev_samp(rating + quality), 6) AS std, round(min(rating + quality), 6) AS low, round(max(rating + quality), 6) AS high FROM inter GROUP BY rating",
)
def a10(spark, d):
    x = V.interactions(spark, d).withColumn("c", F.col("rating") + F.col("quality"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return x.groupBy("rating").agg(F.count("*").alias("n"), r(F.avg("c"), "mean"), r(F.percentile("c", F.lit(0.5)), "median"), r(F.stddev_samp("c"), "std"), r(F.min("c"), "low"), r(F.max("c"), "high"))


_MAP = V.DEDUP + """, um AS (SELECT user_id, CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INTEGER) AS u_idx FROM (SELECT DISTINCT user_id FROM dedup)),
im AS (SELECT product_id, CAST(dense_rank() OVER (ORDER BY product_id) - 1 AS INTEGER) AS i_idx FROM (SELECT DISTINCT product_id FROM dedup)),
mx AS (SELECT u_idx, i_idx, rating + quality AS conf, is_positive, rating FROM dedup JOIN um USING (user_id) JOIN im USING (product_id))"""


def indexed(spark, d, *more):
    """Clean rows, written once, and the dense indices (user_id, u_idx) and (product_id, i_idx) of their keys."""
    x = held(V.clean_interactions(spark, d).select("user_id", "product_id", "rating", "quality", "is_positive", *more))
    return x, U.dense_index(x, "user_id", "u_idx"), U.dense_index(x, "product_id", "i_idx")


def matrix(spark, d, *more):
    """Clean rows with dense indices, and with more of their columns where named."""
    x, users, items = indexed(spark, d, *more)
    return x.join(users, "user_id").join(items, "product_id").withColumn("conf", F.col("rating") + F.col("quality"))


@query("w8_dense_index", f"WITH {_MAP} SELECT user_id, u_idx FROM um")
def w8(spark, d):
    return U.dense_index(V.clean_interactions(spark, d), "user_id", "u_idx")


@query("w9_index_bijection", f'WITH {_MAP} SELECT count(*) AS n, min(i_idx) AS first, max(i_idx) AS last, count(DISTINCT i_idx) AS "distinct" FROM im')
def w9(spark, d):
    return U.index_violations(U.dense_index(V.clean_interactions(spark, d), "product_id", "i_idx"), "i_idx")


@query("j5_dimension_lookup", f"WITH {_MAP} SELECT d.rid, u_idx, i_idx FROM dedup d LEFT JOIN um USING (user_id) LEFT JOIN im USING (product_id)")
def j5(spark, d):
    return matrix(spark, d, "rid").select("rid", "u_idx", "i_idx")


@query("j6_reverse_lookup", f"WITH {_MAP} SELECT DISTINCT user_id, product_id FROM mx JOIN um USING (u_idx) JOIN im USING (i_idx) WHERE rating = 5")
def j6(spark, d):
    x, users, items = indexed(spark, d)
    m = x.where("rating = 5").select("user_id", "product_id").join(users, "user_id").join(items, "product_id").select("u_idx", "i_idx")
    return m.join(users, "u_idx").join(items, "i_idx").select("user_id", "product_id").distinct()


@query("a14_confidence_matrix", f"WITH {_MAP} SELECT u_idx, i_idx, round(sum(conf), 6) AS value FROM mx GROUP BY u_idx, i_idx")
def a14(spark, d):
    return U.confidence_matrix(matrix(spark, d), "conf").withColumn("value", F.round("value", 6))


@query("a15_binary_matrix", f"WITH {_MAP} SELECT u_idx, i_idx, count(*) AS value FROM mx WHERE is_positive = 1 GROUP BY u_idx, i_idx")
def a15(spark, d):
    return U.confidence_matrix(matrix(spark, d).where("is_positive = 1").withColumn("one", F.lit(1)), "one")


@query(
    "a11_matrix_stats",
    f"""WITH {_MAP} SELECT count(*) AS nnz, count(DISTINCT u_idx) AS users, count(DISTINCT i_idx) AS items, round(count(*) / (count(DISTINCT u_idx) * count(DISTINCT i_idx)), 9) AS density, round(avg(conf), 6) AS mean, round(stddev_pop(conf), 6) AS std,
round(quantile_cont(conf, 0.25), 6) AS q25, round(quantile_cont(conf, 0.5), 6) AS q50, round(quantile_cont(conf, 0.75), 6) AS q75 FROM mx""",
)
def a11(spark, d):
    return U.matrix_stats(U.confidence_matrix(matrix(spark, d), "conf"))


@query("v8_preference_transforms", f"WITH {_MAP} SELECT u_idx, i_idx, round((conf - 1) / 5, 6) AS preference, round(1 + 40 * conf, 6) AS scaled, CAST(conf >= 4.5 AS INTEGER) AS strong FROM mx")
def v8(spark, d):
    c = F.col("conf")
    return matrix(spark, d).select("u_idx", "i_idx", F.round((c - 1) / 5, 6).alias("preference"), F.round(1 + 40 * c, 6).alias("scaled"), (c >= 4.5).cast("int").alias("strong"))


@query("a17_positive_sets", f"WITH {V.DEDUP} SELECT user_id, string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY product_id) AS items FROM dedup WHERE is_positive = 1 GROUP BY user_id")
def a17(spark, d):
    x = V.clean_interactions(spark, d).where("is_positive = 1")
    return x.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("product_id")), lambda i: i.cast("string")), ",").alias("items"))


@query("a19_positive_pairs", f"WITH {V.DEDUP} SELECT user_id, product_id, round(rating + quality, 6) AS conf, CAST(rating = 5 AND rating + quality < 5.3 AS INTEGER) AS suspicious FROM dedup WHERE is_positive = 1")
def a19(spark, d):
    c = F.col("rating") + F.col("quality")
    return V.clean_interactions(spark, d).where("is_positive = 1").select("user_id", "product_id", F.round(c, 6).alias("conf"), ((F.col("rating") == 5) & (c < 5.3)).cast("int").alias("suspicious"))


@query("a20_confidence_buckets", f"WITH {V.INTER} SELECT count(*) FILTER (WHERE rating + quality < 4) AS low, count(*) FILTER (WHERE rating + quality >= 4 AND rating + quality < 5) AS mid, count(*) FILTER (WHERE rating + quality >= 5) AS high FROM inter")
def a20(spark, d):
    c = F.col("rating") + F.col("quality")
    return V.interactions(spark, d).agg(F.count_if(c < 4).alias("low"), F.count_if((c >= 4) & (c < 5)).alias("mid"), F.count_if(c >= 5).alias("high"))


@query("a23_popularity", f"WITH {V.DEDUP} SELECT p_partkey AS product_id, coalesce(n, 0) AS n, round(ln(1 + coalesce(n, 0)), 6) AS log_n FROM part LEFT JOIN (SELECT product_id, count(*) AS n FROM dedup GROUP BY product_id) ON product_id = p_partkey")
def a23(spark, d):
    items = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"))
    return U.popularity(V.clean_interactions(spark, d), items).withColumn("log_n", F.round("log_n", 6))


_POP = "pop AS (SELECT product_id, count(*) AS n FROM dedup GROUP BY product_id ORDER BY n DESC, product_id LIMIT {0})"


@query("q2_top_popular", f"WITH {V.DEDUP}, {_POP.format(50)} SELECT * FROM pop")
def q2(spark, d):
    return U.top_popular(V.clean_interactions(spark, d))


@query("j8_implicit_negatives", f"WITH {V.DEDUP}, {_POP.format(20)} SELECT u.user_id, p.product_id FROM (SELECT DISTINCT user_id FROM dedup) u, pop p WHERE NOT EXISTS (SELECT 1 FROM dedup x WHERE x.user_id = u.user_id AND x.product_id = p.product_id)")
def j8(spark, d):
    return U.implicit_negatives(V.clean_interactions(spark, d), 20)


@query(
    "a21_hard_negatives",
    f"WITH {V.DEDUP}, {_POP.format(10)} SELECT DISTINCT user_id, product_id, 'explicit' AS source FROM dedup WHERE rating <= 3 UNION ALL SELECT u.user_id, p.product_id, 'implicit' FROM (SELECT DISTINCT user_id FROM dedup) u, pop p WHERE NOT EXISTS (SELECT 1 FROM dedup x WHERE x.user_id = u.user_id AND x.product_id = p.product_id)",
)
def a21(spark, d):
    return U.hard_negatives(V.clean_interactions(spark, d), 10)


def _split_sql(validation: bool) -> str:
    wanted = "CASE WHEN k = 1 AND n >= 2 THEN 'test' WHEN k = 2 AND n >= 2 THEN 'val' END" if validation else "CASE WHEN k = 1 THEN 'test' END"
    return V.DEDUP + f""", pos AS (SELECT rid, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, rating, rid) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM dedup WHERE is_positive = 1),
held AS (SELECT rid, {wanted} AS split FROM pos), cut AS (SELECT d.*, h.split AS h, min(CASE WHEN h.split IS NOT NULL THEN ts END) OVER (PARTITION BY user_id) AS c FROM dedup d LEFT JOIN held h USING (rid)),
split AS (SELECT *, CASE WHEN h IS NULL AND (c IS NULL OR ts < c) THEN 'train' ELSE h END AS split FROM cut)"""


@query("w5_temporal_split", f"WITH {_split_sql(False)} SELECT rid, split FROM split WHERE split IS NOT NULL")
def w5(spark, d):
    return U.temporal_split(V.clean_interactions(spark, d)).where("split is not null").select("rid", "split")


@query("w3_split_with_validation", f"WITH {_split_sql(True)} SELECT rid, split FROM split WHERE split IS NOT NULL")
def w3(spark, d):
    return U.temporal_split(V.clean_interactions(spark, d), use_validation=True).where("split is not null").select("rid", "split")


@query(
    "w4_negative_holdout",
    f"""WITH {_split_sql(False)} SELECT user_id, rid FROM (SELECT user_id, rid, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, rating, rid) AS k FROM split WHERE rating <= 3 AND (split IS NULL OR split = 'train')
AND user_id IN (SELECT user_id FROM split WHERE split = 'test')) WHERE k = 1""",
)
def w4(spark, d):
    x = V.clean_interactions(spark, d)
    return U.negative_holdout(x, U.temporal_split(x)).select("user_id", "rid")


@query(
    "w6_implicit_holdout",
    f"""WITH {V.DEDUP}, {_POP.format(100)}, r AS (SELECT product_id, row_number() OVER (ORDER BY n DESC, product_id) AS rank FROM pop), f AS (SELECT u.user_id, r.product_id, row_number() OVER (PARTITION BY u.user_id ORDER BY rank) AS k
FROM (SELECT DISTINCT user_id FROM dedup) u, r WHERE NOT EXISTS (SELECT 1 FROM dedup x WHERE x.user_id = u.user_id AND x.product_id = r.product_id)) SELECT user_id, product_id, CAST(k AS INTEGER) AS k FROM f WHERE k <= 4""",
)
def w6(spark, d):
    x = V.clean_interactions(spark, d)
    return U.implicit_holdout(x, x, 4, 100)


@query("w7_order_violations", f"WITH {_split_sql(False)}, t AS (SELECT user_id, min(ts) FILTER (WHERE split = 'test') AS t, max(ts) FILTER (WHERE split = 'train') AS l FROM split GROUP BY user_id) SELECT count(*) FILTER (WHERE t < l) AS violations, count(t) AS test_users FROM t")
def w7(spark, d):
    return U.order_violations(U.temporal_split(V.clean_interactions(spark, d)))


@query("a26_split_metadata", f"WITH {_split_sql(False)} SELECT coalesce(split, 'discarded') AS split, count(*) AS n, count(DISTINCT user_id) AS users FROM split GROUP BY 1")
def a26(spark, d):
    x = U.temporal_split(V.clean_interactions(spark, d))
    return x.groupBy(F.coalesce("split", F.lit("discarded")).alias("split")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("a25_mapping_stats", f"WITH {V.DEDUP} SELECT min(user_id) AS least, max(user_id) AS most, count(DISTINCT user_id) AS n, round(count(DISTINCT user_id) / (max(user_id) - min(user_id) + 1), 6) AS compression FROM dedup")
def a25(spark, d):
    r = V.clean_interactions(spark, d).agg(F.min("user_id").alias("least"), F.max("user_id").alias("most"), F.count_distinct("user_id").alias("n"))
    return r.withColumn("compression", F.round(F.col("n") / (F.col("most") - F.col("least") + 1), 6))


_HALF = "old AS (SELECT DISTINCT user_id FROM inter WHERE rid % 3 <> 0), new AS (SELECT DISTINCT user_id FROM inter WHERE rid % 5 = 0)"


@query("j15_set_overlap", f"WITH {V.INTER}, {_HALF} SELECT count(*) FILTER (WHERE o.user_id IS NOT NULL AND n.user_id IS NOT NULL) AS returning, count(*) FILTER (WHERE o.user_id IS NULL) AS brand_new, count(*) FILTER (WHERE n.user_id IS NULL) AS gone FROM old o FULL JOIN new n ON o.user_id = n.user_id")
def j15(spark, d):
    x = V.interactions(spark, d)
    a = x.where("rid % 3 <> 0").select("user_id").distinct().withColumn("a", F.lit(1))
    b = x.where("rid % 5 = 0").select("user_id").distinct().withColumn("b", F.lit(1))
    both = a.join(b, "user_id", "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("returning"), F.count_if(F.col("a").isNull()).alias("brand_new"), F.count_if(F.col("b").isNull()).alias("gone"))


@query("u2_intersection", f"WITH {V.INTER}, {_HALF} SELECT user_id FROM old INTERSECT SELECT user_id FROM new")
def u2(spark, d):
    x = V.interactions(spark, d)
    return x.where("rid % 3 <> 0").select("user_id").intersect(x.where("rid % 5 = 0").select("user_id"))


@query("u3_difference", f"WITH {V.INTER}, {_HALF} SELECT user_id FROM old EXCEPT SELECT user_id FROM new")
def u3(spark, d):
    x = V.interactions(spark, d)
    return x.where("rid % 3 <> 0").select("user_id").subtract(x.where("rid % 5 = 0").select("user_id"))


@query("j9_semi_join", f"WITH {V.DEDUP} SELECT rid FROM dedup WHERE user_id IN (SELECT user_id FROM dedup GROUP BY user_id HAVING count(*) >= 40)")
def j9(spark, d):
    x = V.clean_interactions(spark, d)
    return x.join(U.user_stats(x).where("n >= 40").select("user_id"), "user_id", "left_semi").select("rid")


@query("j10_user_cutoff", f"WITH {V.DEDUP}, c AS (SELECT user_id, max(ts) AS cut FROM dedup WHERE is_positive = 1 GROUP BY user_id) SELECT rid FROM dedup LEFT JOIN c USING (user_id) WHERE cut IS NULL OR ts < cut")
def j10(spark, d):
    cut = F.max(F.when(F.col("is_positive") == 1, F.col("ts"))).over(Window.partitionBy("user_id"))
    return V.clean_interactions(spark, d).withColumn("cut", cut).where("cut is null or ts < cut").select("rid")


@query(
    "j4_name_join_defaults",
    """WITH a AS (SELECT * FROM (SELECT p_name, p_brand, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part WHERE p_size > 10) WHERE k = 1)
SELECT p.p_partkey AS product_id, coalesce(a.p_brand, 'unknown') AS brand, coalesce(a.p_size, 0) AS size, CAST(a.p_name IS NOT NULL AS INTEGER) AS matched FROM part p LEFT JOIN a ON a.p_name = p.p_name""",
)
def j4(spark, d):
    part = table(spark, d, "part")
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    a = part.where("p_size > 10").withColumn("k", F.row_number().over(w)).where("k = 1").select("p_name", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.lit(1).alias("matched"))
    out = part.select(F.col("p_partkey").alias("product_id"), "p_name").join(a, "p_name", "left")
    return out.select("product_id", "brand", "size", "matched").na.fill({"brand": "unknown", "size": 0, "matched": 0})


@query("w12_first_by_name", "SELECT p_name AS name, min(p_partkey) AS product_id FROM part GROUP BY p_name")
def w12(spark, d):
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    return table(spark, d, "part").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("product_id"))


@query(
    "j16_embedding_alignment",
    "SELECT count(*) AS items, count(vec_id) AS covered, round(count(vec_id) / count(*), 6) AS coverage FROM part LEFT JOIN embeddings ON vec_id = p_partkey",
)
def j16(spark, d):
    items, emb = table(spark, d, "part").select(F.col("p_partkey").alias("vec_id")), table(spark, d, "embeddings").select("vec_id", F.lit(1).alias("hit"))
    r = items.join(emb, "vec_id", "left").agg(F.count("*").alias("items"), F.count("hit").alias("covered"))
    return r.withColumn("coverage", F.round(F.col("covered") / F.col("items"), 6))
