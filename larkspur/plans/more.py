"""Queries of composite and smaller operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vectors as X
from larkspur.operators import graph_index as G
from larkspur.operators import models as L
from larkspur.operators import negatives as N
from larkspur.operators import ranking as R
from larkspur.operators import training as TR
from larkspur.operators import users_items as U
from larkspur.plans import views as V
from larkspur.plans.data import _MAP, _POP, _TRAIN, _split_sql, matrix
from larkspur.plans.opsq import MODELS, models
from larkspur.plans.ranking import TOP, TRUTH, VEC, items, recs, truth, users
from larkspur.plans.registry import query
from larkspur.session import table
from larkspur.sources.shared import Scratch, held


def _r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("a5_user_classes", f"WITH {_TRAIN} SELECT user_id, CASE WHEN is_trainable = 1 THEN 'trainable' ELSE 'cold' END AS class FROM st")
def a5(spark, d):
    t = U.trainable_users(V.clean_interactions(spark, d))
    return t.select("user_id", F.when(F.col("is_trainable") == 1, "trainable").otherwise("cold").alias("class"))


@query("a6_segmentation_violations", "SELECT CAST(0 AS BIGINT) AS short, CAST(0 AS BIGINT) AS without_positive")
def a6(spark, d):
    x = U.with_trainable(V.clean_interactions(spark, d)).where("is_trainable = 1")
    n = x.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("is_positive").alias("pos"))
    return n.agg(F.count_if(F.col("n") < 2).alias("short"), F.count_if(F.col("pos") < 1).alias("without_positive"))


@query("a12_training_summary", f"WITH {_MAP} SELECT count(*) AS nnz, count(DISTINCT u_idx) AS users, count(DISTINCT i_idx) AS items, CASE WHEN avg(conf) < 2 THEN 5 WHEN avg(conf) < 4 THEN 10 ELSE 40 END AS alpha FROM mx")
def a12(spark, d):
    r = matrix(spark, d).agg(F.count("*").alias("nnz"), F.count_distinct("u_idx").alias("users"), F.count_distinct("i_idx").alias("items"), F.avg("conf").alias("m"))
    return r.select("nnz", "users", "items", F.when(F.col("m") < 2, 5).when(F.col("m") < 4, 10).otherwise(40).alias("alpha"))


@query("a16_matrix_validation", f"WITH {_MAP} SELECT count(*) AS cells, (SELECT count(*) FROM dedup) AS source, count(*) FILTER (WHERE conf < 0) AS negative FROM mx")
def a16(spark, d):
    cells = U.confidence_matrix(matrix(spark, d), "conf").agg(F.count("*").alias("cells"), F.count_if(F.col("value") < 0).alias("negative"))
    return cells.crossJoin(V.clean_interactions(spark, d).agg(F.count("*").alias("source")))


@query("a18_positive_pair_stats", f"WITH {V.DEDUP} SELECT count(*) AS pairs, count(DISTINCT user_id) AS users, count(DISTINCT product_id) AS items, round(count(*) / count(DISTINCT user_id), 6) AS per_user FROM dedup WHERE is_positive = 1")
def a18(spark, d):
    r = V.clean_interactions(spark, d).where("is_positive = 1").agg(F.count("*").alias("pairs"), F.count_distinct("user_id").alias("users"), F.count_distinct("product_id").alias("items"))
    return r.withColumn("per_user", F.round(F.col("pairs") / F.col("users"), 6))


@query("a24_user_metadata", f"WITH {_TRAIN} SELECT s.is_trainable, count(*) AS users, round(avg(n), 6) AS mean_n FROM st s JOIN (SELECT user_id, count(*) AS n FROM dedup GROUP BY user_id) c USING (user_id) GROUP BY s.is_trainable")
def a24(spark, d):
    return U.trainable_users(V.clean_interactions(spark, d)).groupBy("is_trainable").agg(F.count("*").alias("users"), F.round(F.avg("n"), 6).alias("mean_n"))


@query("a26_user_split_summary", f"WITH {_split_sql(True)} SELECT user_id, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val, count(*) FILTER (WHERE split = 'test') AS test FROM split GROUP BY user_id")
def a26(spark, d):
    x = U.temporal_split(V.clean_interactions(spark, d), use_validation=True)
    return x.groupBy("user_id").pivot("split", ["train", "val", "test"]).count().na.fill(0)


@query("a29_approximate_coverage")
def a29(spark, d):
    return recs(spark, d, 10).agg(F.approx_count_distinct("item").alias("items"))


@query("a30_cold_items", f"WITH {V.DEDUP}, c AS (SELECT p_partkey AS product_id, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT product_id, count(*) AS n FROM dedup GROUP BY product_id) ON product_id = p_partkey) SELECT count(*) FILTER (WHERE n < 25) AS cold, count(*) AS items, round(avg(n) FILTER (WHERE n < 25), 6) AS mean_cold FROM c")
def a30(spark, d):
    p = U.popularity(V.clean_interactions(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("product_id")))
    cold = F.col("n") < 25
    return p.agg(F.count_if(cold).alias("cold"), F.count("*").alias("items"), F.round(F.avg(F.when(cold, F.col("n"))), 6).alias("mean_cold"))


@query("a42_service_stats", f"WITH {_TRAIN} SELECT count(*) AS users, CAST(sum(is_trainable) AS BIGINT) AS trainable, round(100 * avg(is_trainable), 6) AS trainable_pct FROM st")
def a42(spark, d):
    t = U.trainable_users(V.clean_interactions(spark, d))
    return t.agg(F.count("*").alias("users"), F.sum("is_trainable").alias("trainable"), F.round(100 * F.avg("is_trainable"), 6).alias("trainable_pct"))


@query("a45_embedding_quality", f"WITH {VEC}, n AS (SELECT sqrt(list_dot_product(vec, vec)) AS n FROM vec), c AS (SELECT avg(abs(list_cosine_similarity(a.vec, b.vec))) AS c FROM vec a, vec b WHERE a.id % 100 = 0 AND b.id <> a.id), k AS (SELECT count(vec_id) / count(*) AS k FROM part LEFT JOIN embeddings ON vec_id = p_partkey) SELECT round(1 / (1 + stddev_pop(n) / avg(n)), 6) AS norm_quality, round((SELECT c FROM c), 6) AS mean_abs_cos, round((SELECT k FROM k), 6) AS coverage FROM n")
def a45(spark, d):
    return _r6(R.embedding_quality(V.vectors(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("id"))), "norm_quality", "mean_abs_cos", "coverage")


@query("j16_aligned_vectors", f"WITH {VEC} SELECT p_partkey AS id, CAST(v.id IS NOT NULL AS INTEGER) AS covered, CASE WHEN v.id IS NOT NULL THEN round(sqrt(list_dot_product(vec, vec)), 6) END AS norm FROM part LEFT JOIN vec v ON v.id = p_partkey")
def j16b(spark, d):
    """Every item with a vector; those without one get a draw near the mean, of which the norm isn't shown."""
    items_ = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    out = TR.aligned_vectors(items_, V.vectors(spark, d).select("id", "vec"))
    return out.select("id", F.col("covered").cast("int").alias("covered"), F.when(F.col("covered"), F.round(X.norm(F.col("vec")), 6)).alias("norm"))


def _shares_sql(hard: float) -> str:
    at, cases = 0.0, []
    for name, share in N.strategy_shares(hard).items():
        at += share
        cases.append(f"WHEN u < {at!r} THEN '{name}'" if name != "random" else "ELSE 'random'")
    return f"SELECT {hard!r} AS difficulty, CASE {' '.join(cases)} END AS strategy FROM drawn"


_STAGES = [N.difficulty(epoch, schedule) for epoch, schedule in ((0, "linear"), (30, "exponential"), (55, "cosine"))]


@query("a48_sampling_strategies", f"WITH {_MAP}, drawn AS (SELECT {N.draw_sql(repr('strategy'), 0, 'u_idx', 'i_idx')} AS u FROM mx WHERE is_positive = 1) SELECT difficulty, strategy, count(*) AS n FROM ({' UNION ALL '.join(map(_shares_sql, _STAGES))}) GROUP BY difficulty, strategy")
def a48(spark, d):
    """How often each strategy is drawn at the start, in the middle and at the end of a curriculum."""
    drawn = matrix(spark, d).where("is_positive = 1").select(N.draw("strategy", 0, F.col("u_idx"), F.col("i_idx")).alias("u"))
    stages = F.array(*[F.struct(F.lit(x).alias("difficulty"), N.strategy(x, F.col("u")).alias("strategy")) for x in _STAGES])
    return drawn.select(F.inline(stages)).groupBy("difficulty", "strategy").agg(F.count("*").alias("n"))


@query("u4_union_of_sets", f"WITH {V.DEDUP}, {_POP.format(10)} SELECT user_id, product_id FROM dedup WHERE rating <= 2 UNION SELECT u.user_id, p.product_id FROM (SELECT DISTINCT user_id FROM dedup) u, pop p WHERE NOT EXISTS (SELECT 1 FROM dedup x WHERE x.user_id = u.user_id AND x.product_id = p.product_id)")
def u4(spark, d):
    x = V.clean_interactions(spark, d)
    return x.where("rating <= 2").select("user_id", "product_id").union(U.implicit_negatives(x, 10)).distinct()


@query("q5_heaviest_users", f"WITH {V.INTER} SELECT user_id, count(*) AS n FROM inter GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def q5(spark, d):
    return V.interactions(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("q6_models_by_metric", f"WITH {MODELS} SELECT model_id, CAST(row_number() OVER (ORDER BY recall DESC, model_id) AS INTEGER) AS place FROM models WHERE status = 'active' ORDER BY place LIMIT 20")
def q6(spark, d):
    best = models(spark, d).where("status = 'active'").orderBy(F.desc("recall"), "model_id").limit(20)
    return best.select("model_id", F.row_number().over(Window.orderBy(F.desc("recall"), "model_id")).alias("place"))


@query("q7_recent_requests", f"WITH {V.REQUESTS} SELECT event_id, ts FROM requests WHERE failed = 1 ORDER BY ts DESC, event_id LIMIT 50")
def q7(spark, d):
    return V.requests(spark, d).where("failed = 1").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts")


@query("r4_popularity_fallback", f"WITH {V.DEDUP}, {_POP.format(20)}, f AS (SELECT u.user_id, p.product_id, p.n, row_number() OVER (PARTITION BY u.user_id ORDER BY n DESC, p.product_id) AS rank FROM (SELECT DISTINCT user_id FROM dedup WHERE user_id % 100 = 0) u, pop p WHERE NOT EXISTS (SELECT 1 FROM dedup x WHERE x.user_id = u.user_id AND x.product_id = p.product_id)) SELECT user_id, product_id, round(n / (SELECT max(n) FROM pop), 6) AS score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 10")
def r4(spark, d):
    x = V.clean_interactions(spark, d)
    out = R.popularity_fallback(U.top_popular(x, 20), x.where("user_id % 100 = 0"), x, 10)
    return out.withColumn("score", F.round("score", 6))


# A label's profile is the mean of its history, every fifth vector; the others are searched.
_PROFILE = VEC + ", prof AS (SELECT CAST(label AS BIGINT) AS q, list(v ORDER BY p) AS qv FROM (SELECT label, p, avg(vec[p]) AS v FROM vec, range(1, 65) r(p) WHERE id % 5 = 0 AND label IS NOT NULL GROUP BY label, p) GROUP BY label)"


def _profiles(spark, d):
    p = X.pooled(V.vectors(spark, d).where("id % 5 = 0 AND label IS NOT NULL"), "label", "vec")
    return p.select(F.col("label").cast("long").alias("q"), F.col("vec").alias("qv")), items(spark, d).where("i % 5 <> 0")


@query("r16_profile_search", f"WITH {_PROFILE}, s AS (SELECT q, id AS i, round(list_cosine_similarity(qv, vec), 9) AS score FROM prof, vec WHERE id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rank FROM s) SELECT q, i, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def r16(spark, d):
    return _r6(R.knn_matrix(*_profiles(spark, d), 10), "score")


@query("r5_hybrid_fallback", f"WITH {_PROFILE}, s AS (SELECT q, id AS i, 0.7 * list_cosine_similarity(qv, vec) + 0.3 * (ln(1 + id) / ln(501)) AS score FROM prof, vec WHERE id % 5 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, i) AS rank FROM s) SELECT q, i, round(score, 6) AS score FROM r WHERE rank <= 10")
def r5(spark, d):
    profiles, others = _profiles(spark, d)
    return _r6(R.hybrid_fallback(profiles, others.withColumn("popularity", F.log1p("i") / F.log(F.lit(501.0))), 10).select("q", "i", "score"), "score")


@query("r8_signal_rerank", f"WITH {TOP}, s AS (SELECT user_id, item, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS cf, (item - min(item) OVER w) / (max(item) OVER w - min(item) OVER w) AS pop, (item % 5) / 4.0 AS quality FROM recs WHERE rank <= 20 WINDOW w AS (PARTITION BY user_id)) SELECT user_id, item, round(0.6 * cf + 0.2 * pop + 0.2 * quality, 6) AS final_score FROM s")
def r8(spark, d):
    r = recs(spark, d, 20)
    s = 0.6 * R.min_max(F.col("score"), ["user_id"]) + 0.2 * R.min_max(F.col("item"), ["user_id"]) + 0.2 * (F.col("item") % 5) / 4
    return r.select("user_id", "item", F.round(s, 6).alias("final_score"))


@query("r13_filter_and_boost", f"WITH {V.PRODUCTS} SELECT product_id, round(price * CASE WHEN contains(brand, '#1') THEN 1.2 ELSE 1 END, 6) AS score FROM products WHERE coalesce(price, 0) >= 905")
def r13(spark, d):
    p = V.products(spark, d).where(R.attribute_filter(price_min=905)).withColumn("score", F.col("price"))
    return _r6(R.boost(p, {"brand": [("#1", 1.2)]}).select("product_id", "score"), "score")


@query("r15_similar_products", f"WITH {V.PRODUCTS}, {VEC}, s AS (SELECT a.id AS q, b.id AS product_id, round(list_cosine_similarity(a.vec, b.vec), 9) AS score FROM vec a, vec b WHERE a.id % 100 = 0 AND b.id <> a.id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, product_id) AS rank FROM s) SELECT q, product_id, product_name, round(score, 6) AS score FROM r LEFT JOIN products USING (product_id) WHERE rank <= 10")
def r15(spark, d):
    top = R.knn_matrix(users(spark, d), items(spark, d), 10, exclude_self=True)
    return _r6(top.withColumnRenamed("i", "product_id").join(V.products(spark, d), "product_id", "left").select("q", "product_id", "product_name", "score"), "score")


@query("r17_approximate_neighbours")
def r17(spark, d):
    """An inverted-file index of all vectors, probed in the cells that give the wanted recall on these queries."""
    q, every = users(spark, d), items(spark, d)
    index, centres = R.ivf_index(every)
    index = held(index)
    probes = R.probes_for(q, every, index, centres, 10, 0.9)
    return R.ivf_search(q, index, centres, 10, probes)


@query("r17_graph_neighbours")
def r17_graph(spark, d):
    """Navigable graphs over all vectors, searched for every id divisible by 100."""
    index = Scratch(spark, "graphs").write(G.build_graphs(items(spark, d), links=8, build=64), "index")
    return G.search_graphs(users(spark, d), index, 10, keep=48)


@query("r19_content_score", f"WITH {V.PRODUCTS}, {VEC}, p AS (SELECT v.id, v.vec, brand, category FROM vec v JOIN products ON product_id = v.id), s AS (SELECT a.id AS q, b.id AS i, round(0.7 * list_cosine_similarity(a.vec, b.vec) + 0.2 * CAST(a.category = b.category AS INTEGER) + 0.1 * CASE WHEN a.brand = b.brand THEN 1 ELSE 0.3 END, 9) AS score FROM p a JOIN p b ON a.id % 100 = 0 AND b.id <> a.id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, i) AS rank FROM s) SELECT q, i, round(score, 6) AS score FROM r WHERE rank <= 50")
def r19(spark, d):
    p = V.vectors(spark, d).join(V.products(spark, d).select(F.col("product_id").alias("id"), "brand", "category"), "id")
    return _r6(R.content_score(p.where("id % 100 = 0"), p, 50).select("q", "i", "score"), "score")


@query("r22_sigmoid_scores", f"WITH {TOP}, s AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM recs WHERE rank <= 20) SELECT user_id, item, round(1 / (1 + exp(-(score - m) / s.s)), 6) AS score FROM recs, s WHERE rank <= 20")
def r22(spark, d):
    return _r6(R.sigmoid_scores(recs(spark, d, 20)).select("user_id", "item", "score"), "score")


@query("x1_normalize_query")
def x1(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.normalize_query(F.col("text"), {"th": "the", "er": "error"}).alias("query"))


@query("x9_confidence_score", "SELECT doc_id, round(1 + doc_id % 5 + CASE WHEN text IS NULL OR trim(text) = '' THEN 0.5 ELSE 0.25 END, 6) AS confidence FROM documents")
def x9(spark, d):
    quality = F.when(F.col("text").isNull() | (F.trim("text") == ""), 0.5).otherwise(0.25)
    return table(spark, d, "documents").select("doc_id", F.round(1 + F.col("doc_id") % 5 + quality, 6).alias("confidence"))


@query("x10_score_violations", f"WITH {V.INTER} SELECT count(*) FILTER (WHERE rating + quality < 1 OR rating + quality > 6) AS outside, count(*) FILTER (WHERE rating IS NULL OR quality IS NULL) AS missing FROM inter")
def x10(spark, d):
    c = F.col("rating") + F.col("quality")
    return V.interactions(spark, d).agg(F.count_if((c < 1) | (c > 6)).alias("outside"), F.count_if(c.isNull()).alias("missing"))


@query("v5_softmax", f"WITH {TOP} SELECT user_id, item, round(exp(score) / sum(exp(score)) OVER (PARTITION BY user_id), 6) AS p FROM recs WHERE rank <= 10")
def v5(spark, d):
    e = F.exp("score")
    return recs(spark, d, 10).select("user_id", "item", F.round(e / F.sum(e).over(Window.partitionBy("user_id")), 6).alias("p"))


@query("v9_preference_vectors", f"WITH {_MAP} SELECT u_idx, string_agg(concat(i_idx, ':', CAST(rating AS INTEGER)), ',' ORDER BY i_idx) AS prefs FROM mx WHERE is_positive = 1 GROUP BY u_idx")
def v9(spark, d):
    m = matrix(spark, d).where("is_positive = 1").select("u_idx", F.struct("i_idx", F.col("rating").cast("int").alias("r")).alias("s"))
    return m.groupBy("u_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.concat_ws(":", x["i_idx"], x["r"])), ",").alias("prefs"))


@query("g3_stale_versions", f"WITH {MODELS} SELECT model_id, 50 - created AS age FROM models WHERE 50 - created > 30")
def g3(spark, d):
    return models(spark, d).select("model_id", (50 - F.col("created")).alias("age")).where("age > 30")


@query("g4_linked_models", f"WITH {MODELS} SELECT model_type, string_agg(CAST(model_id AS VARCHAR), ',' ORDER BY model_id) AS linked FROM models GROUP BY model_type")
def g4(spark, d):
    ids = F.transform(F.array_sort(F.collect_list("model_id")), lambda x: x.cast("string"))
    return models(spark, d).groupBy("model_type").agg(F.array_join(ids, ",").alias("linked"))


@query("l4_validation_users", "SELECT DISTINCT o_custkey AS user_id FROM orders WHERE (o_custkey * 7919 + 13) % 1000 < 100")
def l4(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")).distinct().where("(user_id * 7919 + 13) % 1000 < 100")


@query("m22_best_epoch", "SELECT o_orderpriority AS run, max_by(o_orderkey, o_totalprice) AS best FROM orders GROUP BY o_orderpriority")
def m22(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.max_by("o_orderkey", "o_totalprice").alias("best"))


@query("d15_embedding_freshness", f"WITH {MODELS} SELECT model_id, created AS age_days, CAST(created > 30 AS INTEGER) AS stale FROM models")
def d15(spark, d):
    return models(spark, d).select("model_id", F.col("created").alias("age_days"), (F.col("created") > 30).cast("int").alias("stale"))


@query("d16_should_retrain", f"WITH {MODELS} SELECT model_id, concat_ws(',', CASE WHEN created > 30 THEN 'age' END, CASE WHEN recall < 0.12 THEN 'metric' END) AS reasons, CAST(created > 30 OR recall < 0.12 AS INTEGER) AS retrain FROM models")
def d16(spark, d):
    old, low = F.col("created") > 30, F.col("recall") < 0.12
    reasons = F.array_join(F.array_compact(F.array(F.when(old, "age"), F.when(low, "metric"))), ",")
    return models(spark, d).select("model_id", reasons.alias("reasons"), (old | low).cast("int").alias("retrain"))


@query("k6_stats_json", "SELECT p_partkey AS id, concat('{\"size\":', p_size, '}') AS json FROM part")
def k6(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_size").alias("size"))).alias("json"))


@query("k13_review_export", "SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) AS match_count FROM documents WHERE contains(lower(text), 'the')")
def k13(spark, d):
    n = F.regexp_count(F.lower("text"), F.lit("the")).cast("bigint")
    return table(spark, d, "documents").select("doc_id", n.alias("match_count")).where("match_count > 0")


@query("s15_positive_pairs_scan", f"WITH {_split_sql(False)} SELECT user_id, product_id FROM split WHERE split = 'train' AND is_positive = 1")
def s15(spark, d):
    return U.temporal_split(V.clean_interactions(spark, d)).where("split = 'train' AND is_positive = 1").select("user_id", "product_id")


@query(
    "st_late_rows",
    f"""WITH {V.REQUESTS}, b AS (SELECT event_id // 1000 AS batch, max(ts) AS latest FROM requests GROUP BY 1),
w AS (SELECT batch, max(latest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 10 DAY AS mark FROM b)
SELECT date_trunc('day', ts) AS window_start, count(*) AS n, CAST(sum(CASE WHEN ts < mark THEN 1 ELSE 0 END) AS BIGINT) AS late FROM requests JOIN w ON batch = event_id // 1000 GROUP BY 1""",
)
def late(spark, d):
    """If requests arrived in batches of a thousand by id, and the watermark were ten days behind the latest before: how
    many rows of each day a stream would drop."""
    rows = V.requests(spark, d).withColumn("batch", F.floor(F.col("event_id") / 1000).cast("long"))
    latest = rows.groupBy("batch").agg(F.max("ts").alias("latest"))  # a row a batch
    mark = F.max("latest").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)) - F.expr("INTERVAL 10 DAY")
    met = rows.join(latest.select("batch", mark.alias("mark")), "batch")
    return met.groupBy(F.date_trunc("day", "ts").alias("window_start")).agg(F.count("*").alias("n"), F.count_if(F.col("ts") < F.col("mark")).alias("late"))
