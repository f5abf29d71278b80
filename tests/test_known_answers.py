"""Small fixtures with known results, one for each trap of the semantics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions import vectors as X
from larkspur.operators import cleaning as C
from larkspur.operators import metrics as M
from larkspur.operators import models as L
from larkspur.operators import training as TR
from larkspur.operators import ranking as R
from larkspur.operators import stats as S
from larkspur.operators import users_items as U
from larkspur.plans import registry
from larkspur.plans.data import matrix


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, x or 0) for x in r])


def test_coercion_and_dates(spark):
    df = spark.createDataFrame([("7", "3.0", "2024-01-02"), ("3.0", "x", "02/01/2024"), ("bad", "1", "02-01-2024"), (None, "2", "?")], "a string, b string, t string")
    assert rows(C.coerce(df, ["a"], ["b"]).select("a", "b")) == [(7, 3.0)]
    assert rows(C.coercion_losses(df, ["a"], ["b"])) == [("a", 1, 1), ("b", 0, 1)]
    assert C.parse_dates(df, "t").where("t is not null").count() == 3
    assert C.parse_dates(df, "t", "column").where("t is not null").count() == 1  # one format for the whole column


def test_dedup_ties(spark):
    df = spark.createDataFrame([(1, 1, "2024-01-01", 3.0, 1), (1, 1, "2024-01-01", 5.0, 2), (1, 1, "2023-01-01", 4.0, 3)], "u int, i int, t string, r double, k int")
    assert rows(C.dedup_latest(df, ["u", "i"], "t", "r", "k").select("k")) == [(2,)]


def test_split_traps(spark):
    data = [(1, 10, 5.0, "2024-01-01"), (1, 11, 4.0, "2024-01-02"), (1, 12, 2.0, "2024-01-02"), (1, 13, 5.0, "2024-01-03"), (1, 14, 1.0, "2024-01-04"), (2, 15, 5.0, "2024-01-01"), (3, 16, 1.0, "2024-01-01")]
    df = C.label_flags(spark.createDataFrame([(u, r, x, t) for u, r, x, t in data], "user_id int, rid int, rating double, ts string"))
    plain = dict(rows(U.temporal_split(df).select("rid", "split")))
    assert plain == {10: "train", 11: "train", 12: "train", 13: "test", 14: None, 15: "test", 16: "train"}
    val = dict(rows(U.temporal_split(df, use_validation=True).select("rid", "split")))
    assert val == {10: "train", 11: "val", 12: None, 13: "test", 14: None, 15: "train", 16: "train"}


def test_rare_items_keep_uncounted(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 0, 1), (2, 1, 1, 0), (1, 3, 1, 1), (3, 3, 1, 1)], "user_id int, product_id int, is_positive int, is_trainable int")
    assert {r.product_id for r in U.drop_rare_items(df, 2).collect()} == {2, 3}  # item 2 has no trainable positive and stays


def test_dense_index(spark):
    df = spark.createDataFrame([(x,) for x in [900, 5, 5, 17, 3, None]], "k long")
    assert rows(U.dense_index(df, "k", "i")) == [(3, 0), (5, 1), (17, 2), (900, 3)]


def test_metric_known_answer(spark):
    recs = spark.createDataFrame([(0, x, i + 1) for i, x in enumerate([1, 5, 3, 8, 2, 10, 7, 4, 9, 6])], "user_id int, item int, rank int")
    truth = spark.createDataFrame([(0, x) for x in (3, 8, 10, 15)] + [(1, 1)], "user_id int, item int")
    r = {x["user_id"]: x for x in M.per_user(recs, truth, 10).collect()}
    assert (r[0]["recall"], r[0]["precision"], r[0]["hit_rate"]) == (0.75, 0.3, 1.0)
    assert r[0]["mrr"] == pytest.approx(1 / 3)
    assert r[0]["map"] == pytest.approx((1 / 3 + 2 / 4 + 3 / 6) / 4)
    ideal = sum(1 / math.log2(i + 1) for i in range(1, 5))
    assert r[0]["ndcg"] == pytest.approx((1 / 2 + 1 / math.log2(5) + 1 / math.log2(7)) / ideal)
    assert r[1]["recall"] == 0.0 and r[1]["ndcg"] == 0.0  # a user without a list
    lists = spark.createDataFrame([(u, i, 1) for u, xs in enumerate([[1, 2, 3], [3, 4, 5], [5, 6, 7]]) for i in xs], "user_id int, item int, rank int")
    assert M.coverage(lists, spark.range(100).withColumnRenamed("id", "item"), 10).first()["coverage"] == 0.07


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], [4.0, 3.0]), (2, [0.0, 0.0], [1.0, 0.0])], "k int, a array<double>, b array<double>")
    assert rows(df.select("k", X.norm(F.col("a")), X.cosine(F.col("a"), F.col("b")))) == [(1, 5.0, 0.96), (2, 0.0, 0.0)]


def test_rerank_ranges_and_penalty(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.75, 1.5, 2.0)], "cf double")
    assert [r[1] for r in rows(df.select("cf", R.clipped(F.col("cf"), 0.0, 1.5)))] == [0.0, 0.5, 1.0, 1.0]
    lists = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.9, [1.0, 0.0]), (1, 3, 0.8, [0.0, 1.0])], "u int, i int, s double, v array<double>")
    got = dict(rows(R.diversity_penalty(lists, "u", "i", "s", "v").select("i", F.round("s", 6))))
    assert got == {1: 1.0, 2: 0.81, 3: 0.8}


def test_filters_on_missing(spark):
    df = spark.createDataFrame([(1, None, None, "A"), (2, 5.0, 4.0, None), (3, 50.0, 4.5, "b")], "i int, price double, avg_star double, brand string")
    assert [r.i for r in df.where(R.attribute_filter(price_max=10, brand="A")).collect()] == [2]  # a missing brand passes, a missing price is no upper bound's
    assert [r.i for r in df.where(R.index_filter(brand=" B ")).collect()] == [3]


def test_text(spark):
    df = spark.createDataFrame([("  KEM  cn SPF!! ",)], "q string")
    assert df.select(T.normalize_query(F.col("q"), {"kem cn": "kem chống nắng", "kem": "cream", "cn": "x"})).first()[0] == "cream x spf"
    assert df.select(T.word_count(F.col("q"))).first()[0] == 3
    assert spark.createDataFrame([("aaaaaa",)], "t string").select(T.unique_ratio(F.col("t"))).first()[0] == pytest.approx(1 / 6)


def test_statistics(spark):
    assert 2 * S.t_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-5)
    assert S.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    df = spark.createDataFrame([(float(i), float(i) - 1 + (i % 3) * 0.1) for i in range(20)], "a double, b double")
    r = S.paired_t(df, "a", "b", "greater")
    assert r["n"] == 20 and r["t"] > 10 and r["p"] < 1e-6
    assert math.isnan(S.paired_t(df.limit(2), "a", "b")["p"])
    low, high = S.bootstrap(df, "a", 100).first()
    assert low < 9.5 < high
    assert S.permutation_p(df, "a", "b", 100).first()["p"] < 0.05
    same = df.select("a")
    assert S.ks_statistic(same, same, "a").first()["d"] == 0.0 and S.ks_p(0.0, 20, 20) == 1.0


def test_metric_by_name(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "user_id int, item int, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 13), (2, 12), (3, 1)], "user_id int, item int")
    assert M.at_k("recall", recs, truth, 2) == pytest.approx((0.5 + 1 + 0) / 3) and M.at_k("mrr", recs, truth, 2) == pytest.approx((0.5 + 1 + 0) / 3)
    with pytest.raises(ValueError, match="ndcg"):
        M.at_k("other", recs, truth, 2)


def test_shapiro_wilk(spark):
    """The published example of eleven weights (W 0.79, p under 0.01), and data that are normal or not."""
    frame = lambda xs: spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id int, v double")
    n, w, p = S.shapiro_wilk(frame([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]), "v", "id")
    assert n == 11 and w == pytest.approx(0.79, abs=0.005) and 0.005 < p < 0.01
    r = np.random.default_rng(1)
    assert S.shapiro_wilk(frame(r.normal(size=300)), "v", "id")[2] > 0.05 > S.shapiro_wilk(frame(r.exponential(size=300)), "v", "id")[2]
    assert S.shapiro_wilk(frame(range(6000)), "v", "id")[0] == 5000 and math.isnan(S.shapiro_wilk(frame([1, 1, 1]), "v")[1])
    assert 0 < S.shapiro_wilk(frame([1, 2, 4]), "v")[2] <= 1 and 0 < S.shapiro_wilk(frame([1, 2, 4, 8, 9]), "v")[1] < 1


def test_samplers_and_bpr(spark):
    pairs = spark.createDataFrame([(u, (u * 7 + k) % 40) for u in range(30) for k in range(5)], "u_idx int, i_idx int")
    hard = spark.createDataFrame([(u, (u * 7 + 20) % 40) for u in range(30)], "u_idx int, j_idx int")
    neg = L.sample_negatives(pairs, 40, per_pair=3, hard=hard)
    assert neg.count() == 450
    assert neg.join(pairs.select("u_idx", F.col("i_idx").alias("j_idx")), ["u_idx", "j_idx"], "left_semi").isEmpty()
    for opt in (TR.Optimizer(rate=0.3), TR.Optimizer("adagrad", rate=0.1, dropout=0.1), TR.Optimizer("adamw", rate=0.02, clip=0.5)):
        f = TR.train_bpr(neg, rank=8, epochs=6, optimizer=opt, rounds=1)
        assert f.losses[-1] < f.losses[0] and f.users.count() == 30 and np.isfinite([r.features for r in f.items.collect()]).all()
    assert TR.learning_rate("warmup_cosine", 1.0, 0, 10, 5) == 0.2 and TR.learning_rate("linear", 1.0, 10, 10) == 0.0


def test_negatives_cover_every_item(spark, sf_dir):
    heavy = spark.createDataFrame([(0, i) for i in range(2000) if i not in (7, 1900)] + [(1, i) for i in range(2000)], "u_idx int, i_idx int")
    neg = L.sample_negatives(heavy, 2000, per_pair=2).groupBy("u_idx").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("j_idx")).alias("items")).collect()
    assert [tuple(r) for r in neg] == [(0, 2 * 1998, [7, 1900])]  # user 1 has no item left
    top = matrix(spark, sf_dir).agg(F.max("i_idx")).first()[0]
    for name in ("l9_negative_samples", "l11_mixed_negatives"):
        drawn = registry.queries()[name](spark, sf_dir).agg(F.max("j_idx")).first()[0]
        assert 0.9 * top < drawn <= top


def test_als_beats_random(spark):
    pairs = spark.createDataFrame([(u, i, 1.0) for u in range(40) for i in range(30) if i % 3 == u % 3 and (u + i) % 5], "u_idx int, i_idx int, value double")
    model = L.fit_als(pairs, rank=8, maxIter=8, alpha=10.0)
    seen = pairs.select(F.col("u_idx").alias("user_id"), F.col("i_idx").alias("item"))
    recs = L.recommend(model.userFactors, model.itemFactors, seen, 2, blocks=2)
    assert recs.where("item % 3 = user_id % 3").count() / recs.count() > 0.8
    popular = pairs.groupBy(F.col("i_idx").alias("item")).agg(F.count("*").alias("n"))
    asked, own = spark.createDataFrame([(99,), (98,)], "user_id int"), spark.createDataFrame([(98, 0), (98, 1), (98, 1), (7, 3)], "user_id int, item int")
    cold = L.route(recs, asked, popular, 3, own).where("fallback").collect()
    assert len(cold) == 6 and max(r.score for r in cold) == 1.0 and not {0, 1} & {r.item for r in cold if r.user_id == 98}
