"""Steps whose work grew faster than their tables: the same results with bounded work, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import models as L
from larkspur.operators import ranking as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [None, 37])
def test_recommend_blocks(spark, block):
    """Lists over many blocks of items equal brute force, and no scores are shuffled or ranked in a window."""
    r = np.random.default_rng(3)
    u, v = r.normal(size=(60, 4)), r.normal(size=(300, 4)) * r.gamma(1, 1, (300, 1))
    v[200:] = v[100:200]  # copies tie
    seen = sorted({(int(a), int(b)) for a, b in zip(r.integers(0, 50, 900), r.integers(0, 300, 900), strict=True)})
    frame = lambda m: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, features array<double>")
    found = L.recommend(frame(u), frame(v), spark.createDataFrame(seen, "user_id long, item long"), 10, block=block)
    assert "Window" not in _plan(found)
    scores = np.round(np.einsum("id,jd->ij", u, v), 9)
    for a, b in seen:
        scores[a, b] = -np.inf
    wanted = {(a, int(b), k + 1) for a in range(60) for k, b in enumerate(np.lexsort((np.arange(300), -scores[a]))[:10])}
    assert {(x.user_id, x.item, x.rank) for x in found.collect()} == wanted


def test_products_end_early():
    """Items come longest first: those that can't enter any list are never multiplied."""
    r = np.random.default_rng(4)
    v = r.normal(size=(200_000, 8)) + 4
    v *= np.linspace(2, 0.01, len(v))[:, None]
    v = v[np.argsort(-np.linalg.norm(v, axis=1), kind="stable")]
    kept, met = R.Best(r.normal(size=(100, 8)) + 4, 10), []
    kept.offer(v, np.arange(len(v)), lambda rows, part: met.append(len(rows) * (part.stop - part.start)) or (np.empty(0, int), np.empty(0, int)))
    assert sum(met) < 100 * len(v) / 2
    scores = np.round(kept.queries @ v.T, 9)
    assert kept.rows()[1].reshape(100, 10).tolist() == [np.lexsort((np.arange(len(v)), -x))[:10].tolist() for x in scores]


def _vectors(spark, m, names):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{names[0]} long, {names[1]} array<double>").repartition(3)


@pytest.mark.parametrize("fetched", [10, 200_000])
def test_score_quantiles(spark, monkeypatch, fetched):
    """exact quantiles by narrowing ranges, of copies too, over several blocks of queries."""
    monkeypatch.setattr(R, "FETCHED", fetched)
    r = np.random.default_rng(5)
    m = r.normal(size=(90, 3))
    m[30:60] = m[0]  # one score takes a large share
    s, p = R.score_quantiles(_vectors(spark, m[:20], ("q", "qv")), _vectors(spark, m, ("i", "iv")), (0.0, 0.01, 0.37, 0.99, 1.0), block=7)
    scores = np.array([m[a] @ m[b] for a in range(20) for b in range(90) if a != b])
    assert s["n"] == len(scores) and p == pytest.approx(np.quantile(scores, [0.0, 0.01, 0.37, 0.99, 1.0]).tolist(), abs=1e-12)
    assert [s[k] for k in ("low", "high", "mean", "std")] == pytest.approx([scores.min(), scores.max(), scores.mean(), scores.std()], abs=1e-9)


def test_scaled_pairs(spark):
    """scores scaled within a query and all pairs of several blocks, without a shuffle or a window."""
    m = np.random.default_rng(6).normal(size=(40, 3))
    found = R.scored_pairs(_vectors(spark, m[:9], ("q", "qv")), _vectors(spark, m, ("i", "iv")), block=4, scaled=True)
    assert "Exchange hashpartitioning" not in _plan(found) and "Window" not in _plan(found)
    got = {(x.q, x.i): x.score for x in found.collect()}
    for q in range(9):
        own = {i: m[q] @ m[i] for i in range(40) if i != q}
        low, high = min(own.values()), max(own.values())
        assert {i: got.pop((q, i)) for i in own} == pytest.approx({i: (x - low) / (high - low) for i, x in own.items()})
    assert not got


def test_boost_in_parts(spark, sf_dir):
    """a brand's products are met in parts, not in one task of the join."""
    from larkspur.plans import registry

    assert "part" in _plan(registry.queries()["r12_preference_boost"](spark, sf_dir)).split("ShuffledHashJoin")[1].split("\n")[0]


def test_probed_cells(spark):
    """F8: the items of the probed cells are scored in matrix products, with the join's results and without the join."""
    m = np.random.default_rng(7).normal(size=(400, 6))
    m[100:140] = m[:40]
    index, centres = R.ivf_index(_vectors(spark, m, ("i", "iv")), cells=8)
    found = R.ivf_search(_vectors(spark, m[:30], ("q", "qv")), index, centres, 5, probes=3)
    assert "Join" not in _plan(found)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cell = {x.i: x.cell for x in index.collect()}
    for q in range(30):
        near = set(np.argsort(-(unit[q] @ centres.T), kind="stable")[:3].tolist())
        able = [i for i in range(400) if i != q and cell[i] in near]
        wanted = sorted(able, key=lambda i: (-round(float(unit[q] @ unit[i]), 9), i))[:5]
        assert [x.i for x in found.where(F.col("q") == q).orderBy("rank").collect()] == wanted


def test_norm_once(spark):
    """F8: a unit vector takes its norm once, not once an element; zero and null vectors stay."""
    from larkspur.functions.vectors import unit

    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, vec array<double>").select("id", unit(F.col("vec")).alias("u"))
    assert [x.u for x in df.orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("zip_with(") == 1


def test_means_of_any_order(spark, tmp_path):
    """the same prices in another order have the same means, so that differences tie."""
    from larkspur.plans.opsq import pairs

    prices = [0.1, 0.2, 0.3, 1e5 + 0.7]
    rows = [(10 * c + 2 * k + h, c, p) for c, own in ((1, prices), (2, prices[::-1])) for h in (0, 1) for k, p in enumerate(own)] + [(90, 3, 1.0)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    a, b = sorted(pairs(spark, str(tmp_path)).collect())  # a customer of one half has no pair
    assert (a.id, b.id) == (1, 2) and (a.a, a.b) == (b.a, b.b)


def test_contrast_without_neighbours(spark, sf_dir, monkeypatch):
    """contrasting negatives don't search neighbours that they never draw from."""
    from larkspur.plans import registry

    monkeypatch.setattr(R, "knn_matrix", lambda *a, **k: pytest.fail("searched"))
    assert registry.queries()["l10_contrast_negatives"](spark, sf_dir).count() > 0


def test_rounds_are_bounded(spark, monkeypatch):
    """an epoch over many blocks writes all factors ROUNDS times, not once a block; no triplet is left out."""
    from larkspur.operators import training as TR

    made, real = [], TR.bpr_round
    monkeypatch.setattr(TR, "bpr_round", lambda rows, *a: made.append(rows.count()) or real(rows, *a))
    triplets = spark.createDataFrame([(u, (u * 7 + k) % 40, (u + k + 11) % 40) for u in range(30) for k in range(5)], "u_idx int, i_idx int, j_idx int")
    TR.train_bpr(triplets, rank=2, epochs=1, blocks=9)
    assert len(made) == 4 and sum(made) == 150


@pytest.mark.parametrize("held", [7, 1_000_000])
def test_random_lists_are_runs_of_one_order(spark, monkeypatch, held):
    """lists equal brute force over places that tie, batches that drop items, and turns over the end of the circle;
    products of users and items are never made."""
    monkeypatch.setattr(R, "ITEMS_HELD", held)
    users, items = [0, 1, 126, 127, 99_999_700], [*range(40), 5 + R.CIRCLE, 5 + 2 * R.CIRCLE, 7 + R.CIRCLE, 7 + 3 * R.CIRCLE]
    frame = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} long").repartition(2)
    found = R.random_lists(frame(users, "q"), frame(items, "i"), 3, block=2)
    h = {(q, i): (q * R.BY_USER + i * R.BY_ITEM + 17) % R.CIRCLE for q in users for i in items}
    wanted = {(q, i, n + 1) for q in users for n, i in enumerate(sorted(items, key=lambda i: (-h[q, i], i))[:3])}
    assert {(x["q"], x["i"], x["rank"]) for x in found.collect()} == wanted
    assert R.random_lists(frame(users, "q"), frame(items, "i").where("i < 2"), 3).count() == 2 * len(users)
    assert R.random_lists(frame(users, "q"), frame(items, "i").limit(0), 3).isEmpty()


def test_neighbours_within_codes(spark, sf_dir):
    """neighbours of the same codes by products, equal to brute force; nulls have none, and no pairs are joined."""
    from larkspur.plans import registry

    r = np.random.default_rng(6)
    m, label = r.normal(size=(80, 4)), [None if x == 3 else int(x) for x in r.integers(0, 4, 80)]
    rows = spark.createDataFrame([(n, v.tolist(), [c]) for n, (v, c) in enumerate(zip(m, label, strict=True))], "i long, iv array<double>, codes array<bigint>").repartition(3)
    asked = rows.select(F.col("i").alias("q"), F.col("iv").alias("qv"), "codes").where("q % 3 = 0")
    got = {(x.q, x.i, x.rank) for x in R.knn_matrix(asked, rows, 5, exclude_self=True, within=True, block=9).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    wanted = set()
    for q in range(0, 80, 3):
        mine = [i for i in range(80) if i != q and label[i] is not None and label[i] == label[q]]
        wanted |= {(q, i, n + 1) for n, i in enumerate(sorted(mine, key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:5])}
    assert got == wanted
    assert "Join" not in _plan(registry.queries()["j14_filtered_knn"](spark, sf_dir))


def test_deployment_history_is_cut_below_the_shuffle(spark):
    """a key's events are cut to the newest before they meet, with the model before of the oldest that stays."""
    from larkspur.operators import ops

    rows = [(k, n, n * 7 % 5, n // 2) for k in ("a", "b") for n in range(300)] + [("c", 0, 1, 0)]
    events = spark.createDataFrame(rows, "pipeline string, run long, model_id long, ts long").repartition(3)
    h = ops.deployment_history(events, "pipeline", "ts", "run", most=100)
    assert "WindowGroupLimit" in _plan(h)
    got = {(x.pipeline, x.run, x.previous, x.age) for x in h.collect()}
    assert got == {(k, n, (n - 1) * 7 % 5, 300 - n) for k in ("a", "b") for n in range(200, 300)} | {("c", 0, None, 1)}


@pytest.mark.parametrize("name", ["j6_reverse_lookup", "a14_confidence_matrix"])
def test_clean_rows_are_written_once(spark, sf_dir, name):
    """indices and rows come from one written table of clean rows, not from joins of lines and orders each."""
    from larkspur.plans import registry

    assert "l_orderkey" not in _plan(registry.queries()[name](spark, sf_dir))


def test_content_blend_reads_written_rows(spark, sf_dir):
    """what meets the factors are written rows; lines and orders are not joined again for profiles and vectors."""
    from larkspur.plans import registry

    found = registry.queries()["l5_content_blend"](spark, sf_dir)
    assert "l_orderkey" not in _plan(found) and not found.isEmpty()


def test_contextual_pairs_meet_lists_without_histories(spark):
    """Pairs with their users' histories in a table of their own give what rows with histories give, also where
    first draws are seen; a category of one and a user with every item are among them."""
    from larkspur.operators import negatives as N

    pairs = spark.createDataFrame([(u, i) for u in range(12) for i in range(9) if (u * 7 + i * 5) % 3 or u == 11], "u_idx int, i_idx int")
    near = spark.createDataFrame([(0, [1, 2, 3]), (4, [5])], "i_idx int, near array<bigint>")
    kinds = spark.createDataFrame([(i, "abcc"[i // 3] if i < 8 else None) for i in range(9)], "i_idx int, category string")
    pools = N.Pools(9, near=near, categories=kinds)
    got = N.contextual(pairs, pools, 3, histories=N.histories(pairs))
    assert "seen" not in "".join(x for x in _plan(got).splitlines() if "Exchange" in x and "grp" not in x)
    rows = {tuple(x) for x in got.collect()}
    assert rows == {tuple(x) for x in N.contextual(N.with_history(pairs), pools, 3).collect()} and len(rows) == pairs.count()
    seen = {(x.u_idx, x.i_idx) for x in pairs.collect()}
    assert all((u, j) not in seen if u != 11 else j is None for u, _, j, _ in rows) and {w for *_, w in rows} == {"near", "category", "random"}


def test_searched_vectors_are_written(spark, sf_dir, monkeypatch):
    """The search gets vectors that are written, so blocks of queries do not join them again."""
    from larkspur.plans import registry

    plans, search = [], R.knn_matrix
    monkeypatch.setattr(R, "knn_matrix", lambda q, i, *a, **k: plans.append(_plan(q) + _plan(i)) or search(q, i, *a, **k))
    registry.queries()["l10_contextual_negatives"](spark, sf_dir)
    assert len(plans) == 1 and "Join" not in plans[0]


def test_placed_draws_are_not_dealt_by_group(spark):
    """a few groups of items don't make a few tasks, and the popular draw is still the smallest key."""
    import hashlib
    import math
    import re

    from larkspur.operators import negatives as N

    pairs = spark.createDataFrame([(u, i) for u in range(20) for i in range(30) if (u + i) % 3 == 0], "u_idx int, i_idx int")
    rows = N.with_history(pairs)
    pools = N.Pools(30, sentiment=spark.createDataFrame([(i, i % 2 / 1.0) for i in range(30)], "i_idx int, score double"), popular=spark.createDataFrame([(i, 40 - i) for i in range(25)], "i_idx int, n long"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = N.contrasting(rows, pools)
        assert not re.search(r"hashpartitioning\(grp#\d+, \d+\)", _plan(found))
        assert found.count() == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    drawn = lambda *keys: int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:12], 16) / 2**48
    for r in N._popular(rows, pools, 5).collect():
        assert r.j_idx == min((-math.log(drawn("popular", 5, r.u_idx, r.i_idx, j) + 1e-15) / (40 - j), j) for j in range(25) if j not in r.seen)[1]


@pytest.mark.parametrize("per_pair", [1, 3])
def test_popular_keys_are_made_once(spark, per_pair):
    """no filter makes a pair's keys another time; a user who has the whole pool gets none."""
    pairs = spark.createDataFrame([(u, i) for u in range(9) for i in range(20) if (u * i) % 4 == 0 or u == 8], "u_idx int, i_idx int").where("i_idx >= 0")
    found = L.popularity_negatives(pairs, pairs.groupBy("i_idx").agg(F.count("*").alias("n")), per_pair=per_pair, pool=12)
    assert not [x for x in _plan(found).splitlines() if "Filter" in x and "xxhash64" in x]
    seen = {(r.u_idx, r.i_idx) for r in pairs.collect()}
    got = found.collect()
    assert got and not [r for r in got if (r.u_idx, r.j_idx) in seen] and 8 not in {r.u_idx for r in got}


def test_als_error_comes_from_sums(spark):
    """rows don't meet both sides' factors for the error, which is that of the plain sum."""
    from larkspur.operators import training as TR

    cells = [(u, i, 1.0 + (u * i) % 3) for u in range(30) for i in range(12) if (u + i) % 3 == 0 or i == 0]  # item 0 is in parts
    f = TR.train_als(spark.createDataFrame(cells, "u_idx int, i_idx int, value double"), rank=4, rounds=2)
    u, v = ({r.id: np.array(r.features) for r in t.collect()} for t in (f.users, f.items))
    c = np.array([1 + 10.0 * x for _, _, x in cells])
    assert f.losses[-1] == pytest.approx(float((c * np.array([(1 - u[a] @ v[b]) ** 2 for a, b, _ in cells])).sum() / c.sum()), rel=1e-9)
    assert not hasattr(TR, "_known_error")


def test_negatives_within_users(spark):
    """draws are made within a user's row; pairs are shuffled, never each of their draws. The same as a plain loop."""
    pairs = sorted({(u, (u * u + 3 * k * k) % 50) for u in range(20) for k in range(9)}) + [(20, i) for i in range(48)] + [(21, i) for i in range(50)]
    hard = [(u, j) for u in range(0, 22, 2) for j in (1, 7, 33) if (u, j) not in pairs]
    frame, far = spark.createDataFrame(pairs, "u_idx int, i_idx int"), spark.createDataFrame(hard, "u_idx int, j_idx int")
    found = L.sample_negatives(frame, 50, per_pair=3, draws=2, hard=far)
    plan = _plan(found)
    assert "Window" not in plan and plan.index("Generate") < plan.index("Exchange")  # no draw is made below the shuffle
    draws = spark.range(6).select(F.col("id").cast("int").alias("t")).crossJoin(frame)
    place = lambda n, s: F.floor(L.uniform_draw("u_idx", "i_idx", "t", seed=s) * n).cast("int")
    first = {(x.u_idx, x.i_idx, x.t): x.j for x in draws.select("u_idx", "i_idx", "t", place(50, 0).alias("j")).collect()}
    last = {(x.u_idx, x.i_idx, x.t): x.d for x in draws.select("u_idx", "i_idx", "t", L.uniform_draw("u_idx", "i_idx", "t", seed=2).alias("d")).collect()}
    nearest = {}
    for x in frame.join(far, "u_idx").select("u_idx", "i_idx", "j_idx", L.uniform_draw("u_idx", "i_idx", "j_idx", seed=1).alias("h")).collect():
        nearest[x.u_idx, x.i_idx] = min(nearest.get((x.u_idx, x.i_idx), (2, 0)), (x.h, x.j_idx))
    wanted = []
    for u, i in pairs:
        own = {b for a, b in pairs if a == u}
        free = [j for j in range(50) if j not in own]
        js = [nearest[u, i][1]] if (u, i) in nearest else []
        js += [first[u, i, t] for t in range(6) if first[u, i, t] not in own]
        js += [free[int(last[u, i, t] * len(free))] for t in range(3) if free] if len(js) < 3 else []
        wanted += [(u, i, j) for j in js[:3]]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_rounds_send_no_null_lists(spark, monkeypatch):
    """triplets reach a task with an empty list of factors, as a run of null ones is gone over for each row; the
    lists of tasks are made once for triplets that stay, and give what lists of each round give."""
    from larkspur.operators import training as TR

    rows = spark.createDataFrame([(u, (u * 7 + k) % 40, (u + k * 11) % 40, 1.0, u % 3) for u in range(30) for k in range(5)], "u_idx long, i_idx long, j_idx long, w double, task int")
    factors = spark.createDataFrame([(s, i, [0.01 * i, 0.02]) for s in (0, 1) for i in range(50)], "side int, id long, vec array<float>")
    found = TR.bpr_round(rows, factors, TR.Optimizer(), 2, 0.05, 0, 512, [1, 0, 0])
    assert "null AS vec" not in found._jdf.queryExecution().optimizedPlan().toString()
    own = {(r.side, r.id): r.vec for r in found.collect()}
    given = TR.bpr_round(rows, factors, TR.Optimizer(), 2, 0.05, 0, 512, [1, 0, 0], TR.needed(rows))
    assert {(r.side, r.id): r.vec for r in given.collect()} == own
    made, needed = [], TR.needed
    monkeypatch.setattr(TR, "needed", lambda *a: made.append(a[1:]) or needed(*a))
    TR.train_bpr(rows.drop("task"), 2, 2, blocks=2, rounds=2)
    assert made == [("round",)]


def test_popular_draws_are_made_at_once(spark):
    """digests of many pairs and items in one go, not one expression for each; the same numbers as hashlib's."""
    import hashlib

    from larkspur.functions.digests import md5_first48
    from larkspur.operators import negatives as N

    heads, tails = [b"popular:3:%d:%d" % (u, u * u) for u in range(0, 3000, 97)] + [b"", b"x" * 55, b"y" * 70], [b":%d" % j for j in range(0, 2000, 61)] + [b"", b"z" * 60]
    got = md5_first48(heads, tails)
    assert all(int(got[a, b]) == int(hashlib.md5(h + t).hexdigest()[:12], 16) for a, h in enumerate(heads) for b, t in enumerate(tails))
    rows = N.with_history(spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 1), (1, 2)], "u_idx int, i_idx int"))
    found = N._popular(rows, N.Pools(9, popular=spark.createDataFrame([(i, 5 - i) for i in range(3)], "i_idx int, n long")), 1)
    assert "MapInArrow" in _plan(found) and "md5(" not in _plan(found)
    assert {(r.u_idx, r.j_idx) for r in found.collect()} == {(0, 0), (1, None)}
    none = N._popular(rows, N.Pools(9, popular=spark.createDataFrame([], "i_idx int, n long")), 1)
    assert none.where("j_idx IS NULL").count() == 5


def test_content_blend_lists_every_user(spark, sf_dir):
    """F8: all users with a positive that has a vector get a list, not those of an index divisible by 100 alone."""
    from larkspur.plans import registry
    from larkspur.plans import views as V
    from larkspur.plans.data import matrix

    vectors = V.vectors(spark, sf_dir).select(F.col("id").alias("product_id"))
    wanted = {r[0] for r in matrix(spark, sf_dir).where("is_positive = 1").join(vectors, "product_id", "left_semi").select("u_idx").distinct().collect()}
    got = registry.queries()["l5_content_blend"](spark, sf_dir).select("user_id", "rank").collect()
    assert {r.user_id for r in got} == wanted and any(u % 100 for u in wanted) and len(got) == 10 * len(wanted)


def test_users_without_history_are_no_run_of_nulls(spark):
    """F8: users without a history reach a task with an empty one."""
    frame = lambda n: spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(n)], "id int, features array<double>")
    found = L.recommend(frame(6), frame(9), spark.createDataFrame([], "user_id long, item long"), 2)
    assert "null AS seen" not in _plan(found).split("MapInArrow")[1]
    assert {(r.user_id, r.item) for r in found.collect()} == {(u, i) for u in range(6) for i in (7, 8)}


def test_boost_of_every_user(spark, sf_dir):
    """every user's preferred brands are boosted, not those of ids divisible by 100 alone; a task holds products, not users."""
    from larkspur.plans import registry
    from larkspur.plans import views as V

    found = registry.queries()["r12_preference_boost"](spark, sf_dir)
    brands = V.products(spark, sf_dir).where("brand IS NOT NULL").select("product_id")
    users = V.interactions(spark, sf_dir).join(brands, "product_id", "left_semi").select("user_id").distinct()
    assert {r[0] for r in found.select("user_id").distinct().collect()} == {r[0] for r in users.collect()}
    assert "% 100" not in registry.oracle_sql()["r12_preference_boost"] and "BuildRight" in _plan(found).split("ShuffledHashJoin")[1].split("\n")[0]


def test_train_and_test_read_written_rows(spark, sf_dir, monkeypatch):
    """the split and both indices come from clean rows written once, and rows that neither is trained on nor tested are
    not written again."""
    from larkspur.plans import composites as C
    from larkspur.plans import views as V
    from larkspur.operators import users_items as U

    plans, held = [], C.held
    monkeypatch.setattr(C, "held", lambda df: plans.append(_plan(df)) or held(df))
    train, test = C._train_test(spark, sf_dir)
    assert len(plans) == 1 and "l_orderkey" not in plans[0]
    split = U.temporal_split(V.clean_interactions(spark, sf_dir))
    index = lambda key: {r[0]: k for k, r in enumerate(split.select(key).distinct().orderBy(key).collect())}
    u, i = index("user_id"), index("product_id")
    rows = split.where("split IS NOT NULL").collect()
    wanted = sorted((u[r.user_id], i[r.product_id], r.rating + r.quality, r.rating) for r in rows if r.split == "train" and r.is_positive)
    assert sorted(map(tuple, train.collect())) == wanted
    assert sorted(map(tuple, test.collect())) == sorted((u[r.user_id], i[r.product_id]) for r in rows if r.split == "test")


def test_pools_of_a_curriculum_are_written_once(spark, sf_dir):
    """epochs and tries read written lists; neighbours, hard items, moods and counts aren't made again for each."""
    from larkspur.operators import negatives as N
    from larkspur.plans import sampling as P

    pools = P.pools(spark, sf_dir, P._every(spark, sf_dir), kept=True)
    for x in (pools.hard, pools.near, pools.categories, pools.sentiment, pools.popular):
        assert not any(word in _plan(x) for word in ("Aggregate", "Join", "MapInArrow"))
    rows = N.with_history(spark.createDataFrame([(u, i) for u in range(9) for i in range(9) if (u + i) % 4 == 0], "u_idx int, i_idx int"))
    hard = spark.createDataFrame([(u, (u * 5 + k) % 9) for u in range(7) for k in range(3)], "u_idx int, j_idx int")
    drawn = [sorted(map(tuple, N._hard(rows, N.Pools(9, hard=h), 2).select("u_idx", "i_idx", "j_idx").collect()), key=str) for h in (hard, N.hard_lists(hard))]
    assert drawn[0] == drawn[1] and any(j is not None for *_, j in drawn[0])
