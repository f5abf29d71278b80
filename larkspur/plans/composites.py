"""Composite queries: evaluation pipelines, training variants, bundles and change checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vectors as X
from larkspur.operators import metrics as M
from larkspur.operators import models as L
from larkspur.operators import ops as O
from larkspur.operators import ranking as R
from larkspur.operators import stats as S
from larkspur.operators import training as TR
from larkspur.operators import users_items as U
from larkspur.plans import views as V
from larkspur.plans.data import _MAP, indexed, matrix
from larkspur.plans.opsq import PAIRS, pairs
from larkspur.plans.ranking import _FINAL, _HITS, _SIGNALS, TRUTH, VEC, items, recs, signals, truth, users
from larkspur.plans.registry import query
from larkspur.session import table
from larkspur.sources.shared import held


@query("a13_alpha_rules", f"WITH {_MAP}, s AS (SELECT count(*) / (count(DISTINCT u_idx) * count(DISTINCT i_idx)) AS density, avg(conf) AS mean FROM mx) SELECT round(density, 9) AS density, CASE WHEN density < 0.001 THEN 40 WHEN density < 0.01 THEN 20 ELSE 10 END AS by_density, CASE WHEN mean < 2 THEN 5 WHEN mean < 4 THEN 10 ELSE 40 END AS by_mean FROM s")
def a13(spark, d):
    r = matrix(spark, d).agg((F.count("*") / (F.count_distinct("u_idx") * F.count_distinct("i_idx"))).alias("density"), F.avg("conf").alias("mean"))
    by_density = F.when(F.col("density") < 0.001, 40).when(F.col("density") < 0.01, 20).otherwise(10)
    return r.select(F.round("density", 9).alias("density"), by_density.alias("by_density"), F.when(F.col("mean") < 2, 5).when(F.col("mean") < 4, 10).otherwise(40).alias("by_mean"))


@query("a22_training_bundle", f"WITH {V.DEDUP} SELECT user_id, count(*) FILTER (WHERE is_positive = 1) AS positives, count(*) FILTER (WHERE rating <= 3) AS hard_negatives, round(sum(CASE WHEN is_positive = 1 THEN rating + quality ELSE 0 END), 5) AS confidence FROM dedup GROUP BY user_id")
def a22(spark, d):
    pos = F.col("is_positive") == 1
    x = V.clean_interactions(spark, d).groupBy("user_id")
    return x.agg(F.count_if(pos).alias("positives"), F.count_if(F.col("rating") <= 3).alias("hard_negatives"), F.round(F.sum(F.when(pos, F.col("rating") + F.col("quality")).otherwise(0)), 5).alias("confidence"))


@query("r2_batch_recommend", f"WITH {TRUTH}, f AS (SELECT s.user_id, s.item, s.score, row_number() OVER (PARTITION BY s.user_id ORDER BY round(s.score, 9) DESC, s.item) AS rank FROM scored s WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.user_id = s.user_id AND t.item = s.item)) SELECT user_id, item, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 10")
def r2(spark, d):
    v = V.vectors(spark, d).select("id", F.col("vec").alias("features"))
    own = v.where("id % 100 = 0").select(F.col("id").alias("user_id"), F.col("id").alias("item"))
    out = L.recommend(v.where("id % 100 = 0"), v, truth(spark, d).unionByName(own), 10, blocks=3)
    return out.withColumn("score", F.round("score", 6))


#: Parts that a brand's products are dealt to.
PARTS = 64


@query("r12_preference_boost", f"WITH {V.PRODUCTS}, {V.DEDUP}, c AS (SELECT user_id, brand, count(*) AS n FROM dedup JOIN products USING (product_id) GROUP BY user_id, brand), p AS (SELECT user_id, brand, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, brand) AS k FROM c) SELECT p.user_id, x.product_id, round(x.price * CASE WHEN k = 1 THEN 1.2 ELSE 1.1 END, 6) AS score FROM p JOIN products x ON x.brand = p.brand WHERE k <= 3")
def r12(spark, d):
    products = V.products(spark, d)
    x = V.clean_interactions(spark, d).join(products.select("product_id", "brand"), "product_id")
    prefs = R.preferences(x, "user_id", "brand").select("user_id", "brand", "pref")
    # Brands are few, so products are dealt to parts and each preference goes to all parts: a task holds its parts of brands
    # and preferences pass by.
    # A product has two scores, rounded before they are multiplied by its users.
    scores = [F.round(F.col("price") * by, 6).alias(name) for name, by in (("first", 1.2), ("other", 1.1))]
    dealt = products.select("brand", "product_id", *scores, F.pmod(F.xxhash64("product_id"), F.lit(PARTS)).alias("part"))
    asked = prefs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    met = asked.join(dealt.hint("shuffle_hash"), ["brand", "part"])
    return met.select("user_id", "product_id", F.when(F.col("pref") == 1, F.col("first")).otherwise(F.col("other")).alias("score"))


@query("r18_metadata_index", f"WITH {V.PRODUCTS} SELECT lower(trim(brand)) AS brand, lower(trim(category)) AS category, count(*) AS n, min(product_id) AS first FROM products GROUP BY 1, 2")
def r18(spark, d):
    key = lambda c: F.lower(F.trim(c)).alias(c)
    return V.products(spark, d).groupBy(key("brand"), key("category")).agg(F.count("*").alias("n"), F.min("product_id").alias("first"))


_RERANKED = f"{_SIGNALS}, rr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round({_FINAL}, 9) DESC, item) AS new_rank FROM sg)"


def reranked(spark, d):
    s = R.combine(signals(spark, d)).withColumn("final_score", F.round("final_score", 9))
    return R.top_k(s.drop("rank"), ["user_id"], "final_score", 20, "item")


@query("r23_ensemble_recommend", f"WITH {_RERANKED} SELECT user_id, item, CAST(new_rank AS INTEGER) AS rank FROM rr WHERE new_rank <= 10")
def r23(spark, d):
    return reranked(spark, d).where("rank <= 10").select("user_id", "item", "rank")


@query("m15_evaluate_cutoffs", f"WITH {TRUTH}, g AS (SELECT user_id, count(*) AS n FROM truth GROUP BY user_id), k AS (SELECT unnest([5, 10, 20]) AS k), h AS (SELECT k, r.user_id, count(*) AS hits FROM k JOIN recs r ON r.rank <= k JOIN truth t ON t.user_id = r.user_id AND t.item = r.item GROUP BY k, r.user_id) SELECT CAST(k.k AS INTEGER) AS k, round(avg(coalesce(hits, 0) / n), 6) AS recall, round(avg(coalesce(hits, 0) / k.k), 6) AS precision FROM k CROSS JOIN g LEFT JOIN h ON h.k = k.k AND h.user_id = g.user_id GROUP BY k.k")
def m15(spark, d):
    r, t = recs(spark, d, 20), truth(spark, d)
    out = None
    for k in (5, 10, 20):
        one = M.per_user(r, t, k, ["recall", "precision"]).agg(F.lit(k).alias("k"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"))
        out = one if out is None else out.unionByName(one)
    return out


@query("m18_rerank_effect", f"WITH {_RERANKED}, t AS (SELECT u.id AS user_id, i.id AS item FROM vec u JOIN vec i ON u.label = i.label WHERE u.id % 100 = 0 AND i.id <> u.id AND i.id % 3 = 0), g AS (SELECT user_id, count(*) AS n FROM t GROUP BY user_id), h AS (SELECT rr.user_id, count(*) FILTER (WHERE rank <= 10) AS a, count(*) FILTER (WHERE new_rank <= 10) AS b FROM rr JOIN t USING (user_id, item) GROUP BY rr.user_id) SELECT round(avg(coalesce(a, 0) / n), 6) AS before, round(avg(coalesce(b, 0) / n), 6) AS after FROM g LEFT JOIN h USING (user_id)")
def m18(spark, d):
    t = truth(spark, d)
    before = M.per_user(recs(spark, d, 10), t, 10, ["recall"]).agg(F.round(F.avg("recall"), 6).alias("before"))
    return before.crossJoin(M.per_user(reranked(spark, d), t, 10, ["recall"]).agg(F.round(F.avg("recall"), 6).alias("after")))


@query("m16_baseline_comparison", f"WITH {_HITS}, b AS (SELECT item, row_number() OVER (ORDER BY sum(score) DESC, item) AS k FROM scored GROUP BY item), bh AS (SELECT user_id, count(*) AS hits FROM truth JOIN b USING (item) WHERE k <= 10 GROUP BY user_id) SELECT 'model' AS who, round(avg(hits / n), 6) AS recall FROM p UNION ALL SELECT 'popular', round(avg(coalesce(hits, 0) / n), 6) FROM g LEFT JOIN bh USING (user_id)")
def m16(spark, d):
    r, t = recs(spark, d, 10), truth(spark, d)
    top = R.popular_by_factors(users(spark, d), items(spark, d), 10)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "item"))).select("item", "rank")
    mean = lambda who, x: M.per_user(x, t, 10, ["recall"]).agg(F.lit(who).alias("who"), F.round(F.avg("recall"), 6).alias("recall"))
    return mean("model", r).unionByName(mean("popular", t.select("user_id").distinct().crossJoin(F.broadcast(top))))


@query("m14_beyond_accuracy", f"WITH {_SIGNALS}, d AS (SELECT a.user_id, least(greatest(1 - avg(list_cosine_similarity(a.vec, b.vec)), 0), 1) AS d FROM sg a JOIN sg b ON a.user_id = b.user_id AND a.rank < b.rank GROUP BY a.user_id), c AS (SELECT user_id, least(greatest(avg(content), 0), 1) AS c FROM sg GROUP BY user_id) SELECT round(avg(d), 5) AS diversity, round(avg(c), 5) AS alignment FROM d JOIN c USING (user_id)")
def m14(spark, d):
    s = signals(spark, d)
    align = s.groupBy("user_id").agg(F.least(F.greatest(F.avg("content"), F.lit(0.0)), F.lit(1.0)).alias("c"))
    return R.list_diversity(s, "user_id", "vec", "rank").join(align, "user_id").agg(F.round(F.avg("diversity"), 5).alias("diversity"), F.round(F.avg("c"), 5).alias("alignment"))


@query("d4_glass_delta", f"WITH {PAIRS} SELECT round(avg(a - b) / stddev_samp(b), 6) AS delta, CASE WHEN abs(avg(a - b) / stddev_samp(b)) < 0.2 THEN 'negligible' WHEN abs(avg(a - b) / stddev_samp(b)) < 0.5 THEN 'small' WHEN abs(avg(a - b) / stddev_samp(b)) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM pr")
def d4(spark, d):
    x = S.effect_sizes(pairs(spark, d), "a", "b")
    size = F.abs("glass_delta")
    return x.select(F.col("glass_delta").alias("delta"), F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large").alias("label"))


@query("d5_confidence_interval")
def d5(spark, d):
    return spark.createDataFrame([S.confidence_interval(pairs(spark, d), "a")], "mean double, low double, high double")


@query("d7_normality", f"WITH {PAIRS}, m AS (SELECT avg(a) AS m, stddev_pop(a) AS s FROM pr), z AS (SELECT count(*) AS n, avg(pow((a - m) / s, 3)) AS sk, avg(pow((a - m) / s, 4)) - 3 AS k FROM pr, m) SELECT n, round(sk, 6) AS skew, round(k, 6) AS excess_kurtosis, round(n / 6 * (sk * sk + k * k / 4), 5) AS jarque_bera FROM z")
def d7(spark, d):
    return S.normality(pairs(spark, d), "a")


@query("d7_shapiro_wilk")
def d7b(spark, d):
    return spark.createDataFrame([S.shapiro_wilk(pairs(spark, d), "a", key="id")], "n long, w double, p double")


@query("d8_compare_models", f"WITH {PAIRS} SELECT id % 4 AS model, count(*) AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t, round(avg(a - b) / stddev_samp(a - b), 6) AS d FROM pr GROUP BY id % 4")
def d8(spark, d):
    return S.compare_models(pairs(spark, d).withColumn("model", F.col("id") % 4), "model", "a", "b")


@query("d8_corrected_comparison")
def d8_holm(spark, d):
    """Each model against its baseline, with one-sided p-values and their corrections."""
    return S.compare_corrected(pairs(spark, d).withColumn("model", F.col("id") % 4), "model", "a", "b")


@query("d19_latency_profile", f"WITH {V.REQUESTS}, p AS (SELECT event_type AS component, quantile_cont(latency_ms, 0.95) AS p95 FROM requests GROUP BY event_type) SELECT component, round(p95, 6) AS p95, CAST(p95 > 40 AS INTEGER) AS slow FROM p")
def d19(spark, d):
    p = O.load_summary(V.requests(spark, d), 40, "event_type")
    return p.select(F.col("event_type").alias("component"), "p95", (F.col("p95") > 40).cast("int").alias("slow"))


@query("x6_batch_scores", "SELECT doc_id, round(1 / (1 + exp(-(0.8 * len(regexp_extract_all(lower(text), '\\b(?:the|of|and)\\b')) - 0.05 * len(regexp_extract_all(text, '[^ ]+'))))), 9) AS score FROM documents")
def x6(spark, d):
    """A logistic model of three words' counts and the length, run batch by batch as a sentiment model would be."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return T.score_texts(docs, "text", T.word_model({"the": 0.8, "of": 0.8, "and": 0.8}, -0.05)).drop("text").withColumn("score", F.round("score", 9))


@query("x8_token_adjustment", "SELECT p_partkey AS id, round(least(0.03 * (p_size % 5), 0.1) - least(0.05 * (p_size % 2), 0.15), 6) AS adj FROM part")
def x8(spark, d):
    n = lambda word, k: F.repeat(F.lit(f" {word}"), k.cast("int"))
    text = F.concat(F.lit("nice"), n("thumbs_up_light_skin_tone", F.col("p_size") % 5), n("angry_face", F.col("p_size") % 2))
    adj = T.token_adjustment(text, ["thumbs_up", "red_heart"], ["angry_face"])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(adj, 6).alias("adj"))


@query("v3_masked_mean_pooling", f"WITH {VEC}, e AS (SELECT label, p, avg(vec[p]) AS v FROM vec, range(1, 65) r(p) WHERE id % 3 <> 0 GROUP BY label, p) SELECT label, round(sum(v * v), 6) AS square FROM e GROUP BY label")
def v3(spark, d):
    p = X.pooled(V.vectors(spark, d).where("id % 3 <> 0"), "label", "vec")
    return p.select("label", F.round(X.dot(F.col("vec"), F.col("vec")), 6).alias("square"))


@query("v6_text_search")
def v6(spark, d):
    """Conversations nearest to stated queries, by hashed word vectors."""
    v = T.hashed_vector(table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("i"), "text"), "text", name="iv")
    return R.knn_matrix(v.where("floor(i / 1000) % 100 = 0").select(F.col("i").alias("q"), F.col("iv").alias("qv")), v, 5, exclude_self=True)


@query("y2_dates", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders")
def y2(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("g7_change_detection", "WITH o AS (SELECT o_orderpriority AS part, o_orderkey, o_totalprice FROM orders), n AS (SELECT part, o_orderkey, CASE WHEN part LIKE '1%' AND o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM o WHERE NOT (part LIKE '2%' AND o_orderkey = (SELECT min(o_orderkey) FROM o WHERE part LIKE '2%'))) SELECT part, CAST(count(*) FILTER (WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice) > 0 AS INTEGER) AS changed FROM (SELECT part, o_orderkey, o_totalprice FROM o) a LEFT JOIN n b USING (part, o_orderkey) GROUP BY part")
def g7(spark, d):
    """Which parts of a table changed between two versions, by their content hashes: one has new prices, one lost a row."""
    old = table(spark, d, "orders").select(F.col("o_orderpriority").alias("part"), "o_orderkey", "o_totalprice")
    lost = old.where("part LIKE '2%'").agg(F.min("o_orderkey").alias("lost"))
    price = F.when(F.col("part").like("1%") & (F.col("o_orderkey") % 7 == 0), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = old.join(F.broadcast(lost), F.col("o_orderkey") == F.col("lost"), "left_anti").withColumn("o_totalprice", price).orderBy(F.desc("o_orderkey"))
    return O.changed_parts(old, new, "part")


@query("l2_als_input", f"WITH {_MAP} SELECT u_idx, i_idx, round(1 + 10 * conf, 6) AS value FROM mx WHERE is_positive = 1")
def l2(spark, d):
    return matrix(spark, d).where("is_positive = 1").select("u_idx", "i_idx", F.round(1 + 10 * F.col("conf"), 6).alias("value"))


def _train_test(spark, d):
    # Split and indices read written rows, and only what is trained on or tested meets the indices.
    x, users, items = indexed(spark, d, "ts", "rid")
    used = U.temporal_split(x).where("split = 'test' OR split = 'train' AND is_positive = 1").select("user_id", "product_id", "split", "rating", (F.col("rating") + F.col("quality")).alias("value"))
    x = held(used.join(users, "user_id").join(items, "product_id").select("u_idx", "i_idx", "value", "rating", "split"))
    train = x.where("split = 'train'").select("u_idx", "i_idx", "value", "rating")
    return train, x.where("split = 'test'").select(F.col("u_idx").alias("user_id"), F.col("i_idx").alias("item"))


def _evaluated(name, users, item_factors, train, test):
    found = L.recommend(users, item_factors, train.select(F.col("u_idx").alias("user_id"), F.col("i_idx").alias("item")), 10)
    return M.per_user(found, test, 10, ["recall", "ndcg"]).agg(F.lit(name).alias("model"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))


@query("l13_train_and_select")
def l13(spark, d):
    """ALS and weighted BPR on the same split; each one's metrics, the better first."""
    train, test = _train_test(spark, d)
    als = L.fit_als(train.select("u_idx", "i_idx", "value"), rank=8, maxIter=3)
    n = train.agg(F.max("u_idx"), F.max("i_idx")).first()
    weighted = L.sample_negatives(train, n[1] + 1, 1).join(train.select("u_idx", "i_idx", L.confidence_weights(F.col("rating"), F.col("value")).alias("w")), ["u_idx", "i_idx"])
    f = TR.train_bpr(weighted, ids=(train.select(F.col("u_idx").alias("id")), spark.range(n[1] + 1)), rank=8, epochs=2, weight="w", optimizer=TR.Optimizer("adagrad", schedule="cosine"))
    both = _evaluated("als", als.userFactors, als.itemFactors, train, test).unionByName(_evaluated("bpr", f.users, f.items, train, test))
    return both.orderBy(F.desc("recall"), "model")


@query("l12_initial_factors")
def l12(spark, d):
    return L.initial_factors(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 8)


@query("l5_content_blend")
def l5(spark, d):
    """ALS scores blended with content similarity for items that have vectors."""
    m = held(matrix(spark, d).where("is_positive = 1").select("u_idx", "i_idx", "product_id", "conf"))
    als = L.fit_als(m.select("u_idx", "i_idx", F.col("conf").alias("value")), rank=8, maxIter=3)
    vec = V.vectors(spark, d).select(F.col("id").alias("product_id"), X.unit(F.col("vec")).alias("vec"))
    # An item's vector is met once, not once a row, and only by rows of items that have one.
    of_item = held(m.select(F.col("i_idx").alias("id"), "product_id").distinct().join(vec, "product_id").select("id", "vec"))
    rows = m.select("u_idx", F.col("i_idx").alias("id")).join(of_item, "id")
    # Written, as the factors of users with a profile are read once for each block of items.
    profile = held(X.pooled(rows, "u_idx", "vec").select(F.col("u_idx").alias("id"), "vec"))
    return L.content_blend(als.userFactors, als.itemFactors, profile, of_item, 10)
