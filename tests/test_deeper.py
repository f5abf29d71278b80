"""Truncated SVD, signed ranks, match spans, latency sketches and late rows against plain versions."""

import datetime as dt
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import models as L
from larkspur.operators import ops as O
from larkspur.operators import stats as S
from larkspur.streaming import health


@pytest.mark.parametrize("centre", [True, False])
def test_truncated_svd(spark, centre):
    """Fewer basis vectors than dimensions, a falling spectrum, nulls; values within 1e-6 of numpy's."""
    r = np.random.default_rng(4)
    m = r.normal(size=(400, 40)) @ np.diag(0.8 ** np.arange(40)) @ np.linalg.qr(r.normal(size=(40, 40)))[0] + (3.0 if centre else 0.0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(999, None)], "id long, vec array<double>").repartition(4)
    d = L.truncated_svd(df, "vec", 5, centre=centre, extra=6)
    moved = m - m.mean(axis=0) if centre else m
    u, s, vt = np.linalg.svd(moved, full_matrices=False)
    assert d.values == pytest.approx(s[:5], rel=1e-6) and d.passes < 60
    assert d.explained == pytest.approx(s[:5] ** 2 / (moved**2).sum(), rel=1e-6)
    assert np.abs(np.abs((d.vectors * vt[:5].T).sum(axis=0)) - 1).max() < 1e-5 and (d.vectors[np.abs(d.vectors).argmax(axis=0), range(5)] > 0).all()
    got = np.array([x.factors for x in d.apply(df.where("vec IS NOT NULL"), "vec", whiten=True).orderBy("id").collect()])
    assert np.abs(np.abs((got * u[:, :5]).sum(axis=0)) - 1).max() < 1e-5
    whole = L.truncated_svd(df, "vec", 99, centre=centre)
    assert whole.passes == 1 and whole.values == pytest.approx(s, abs=1e-6) and whole.explained.sum() == pytest.approx(1)
    with pytest.raises(ValueError, match="no vectors"):
        L.truncated_svd(df.where("id = 999"), "vec", 2)


def _pairs(spark, d):
    return spark.createDataFrame([(float(x), 0.0) for x in d], "a double, b double")


def test_signed_ranks(spark):
    """Published: of ten differences, a rank sum of 8 has a two-sided p of 0.0488."""
    for n in (3, 7, 10):
        every = [sum(k for k, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
        assert S.signed_ranks(n) == pytest.approx([every.count(w) / 2**n for w in range(n * (n + 1) // 2 + 1)])
    d = [1, 2, -3, 4, -5, 6, 7, 8, 9, 10]  # 0.8 of the distribution: the negative ones sum to 8
    got = S.wilcoxon_test(_pairs(spark, [*d, 0, 0]), "a", "b")
    assert got["n"] == 10 and got["statistic"] == 8 and got["p"] == pytest.approx(50 / 1024)
    assert S.wilcoxon_test(_pairs(spark, d), "a", "b", "greater")["p"] == pytest.approx(25 / 1024) and S.wilcoxon_test(_pairs(spark, d), "a", "b", "less")["p"] == pytest.approx(1 - 19 / 1024)
    assert math.isnan(S.wilcoxon_test(_pairs(spark, d[:9]), "a", "b")["p"])


def test_signed_ranks_with_ties(spark):
    d = [1, 1, 1, -1, 2, 2, -2, 3, 3, 4, 5, 5, -6, 7]
    ranks = {v: sum(abs(x) < v for x in d) + (sum(abs(x) == v for x in d) + 1) / 2 for v in map(abs, d)}
    plus = sum(ranks[abs(x)] for x in d if x > 0)
    n, ties = len(d), sum(t**3 - t for t in (4, 3, 2, 2))
    z = (plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    got = S.wilcoxon_test(_pairs(spark, d), "a", "b")
    assert got["statistic"] == n * (n + 1) / 2 - plus and got["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    big = S.wilcoxon_test(_pairs(spark, [x + 0.001 * k for k, x in enumerate(range(-40, 60))]), "a", "b", "greater")  # untied, but too many
    assert big["n"] == 100 and 0 < big["p"] < 0.05


def test_compared_models(spark):
    r = random.Random(5)
    rows = [(m, r.gauss(0.3 * m, 1), 0.0) for m in range(4) for _ in range(60)]
    got = {x.model: x for x in S.compare_corrected(spark.createDataFrame(rows, "model int, a double, b double"), "model", "a", "b").collect()}
    assert got[0].holm_reject == 0 and got[3].holm_reject == 1
    order = sorted(got.values(), key=lambda x: x.p)
    for k, x in enumerate(order):
        assert x.p == pytest.approx(S.t_tail(x.t, 59)) and x.bonferroni_p == pytest.approx(min(1, 4 * x.p)) and x.holm_p == pytest.approx(min(1, (4 - k) * x.p))


@pytest.mark.parametrize(("pattern", "mode", "case"), [("a", "literal", False), ("a.b", "literal", True), ("ab", "word", False), ("[ab]+c?", "regex", True), ("é🙂|b", "regex", False)])
def test_match_spans(spark, pattern, mode, case):
    r = random.Random(6)
    texts = [None, "", "aaa", "xab ab.ab abc A.B a.b", "é🙂éab🙂é🙂", *["".join(r.choice("aAbBc é🙂.") for _ in range(n)) for n in (10, 300, 3000)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    regex = re.compile({"literal": re.escape(pattern), "word": rf"\b{re.escape(pattern)}\b", "regex": pattern}[mode], 0 if case else re.IGNORECASE)
    want = {i: [(m.start(), m.end(), m.group()) for m in regex.finditer(t)] for i, t in enumerate(texts) if t is not None}
    got = {x.id: x.s for x in df.select("id", T.match_spans(F.col("text"), pattern, mode, case).alias("s")).collect()}
    assert got.pop(0) is None and {i: [tuple(x) for x in s] for i, s in got.items()} == want
    rows = T.matches(df, "text", pattern, mode, case).collect()
    assert sorted((x.id, x.k, x.start, x.end, x.match) for x in rows) == sorted((i, k + 1, *m) for i, ms in want.items() for k, m in enumerate(ms))
    marked = {x.id: x.m for x in df.select("id", T.highlight(F.col("text"), pattern, mode, case, "<$", "\\>").alias("m")).collect()}
    assert all(marked[i] == regex.sub(lambda m: f"<${m.group()}\\>", texts[i]) for i in want)


def test_sketches_roll_up(spark):
    """Five hundred thousand latencies in minutes, rolled up twice: sums are exact, ranks within 2 %."""
    raw = spark.range(500_000).select((F.timestamp_seconds(1_700_000_000 + F.col("id") % 40_000)).alias("ts"), (F.rand(3) * F.rand(4) * 100).alias("latency_ms"), (F.col("id") % 4 == 0).cast("int").alias("fallback"), F.lit(0).alias("failed")).cache()
    minutes = O.latency_sketches(raw).cache()
    day = O.roll_up(O.roll_up(minutes, "1 hour"), "1 day")
    got = O.sketch_health(day).collect()
    assert sum(x.n for x in got) == 500_000 and all(abs(x.fallback_rate - 0.25) < 0.01 and x.error_rate == 0 for x in got)
    for x in got:
        own = [r[0] for r in raw.where((F.window("ts", "1 day")["start"] == F.lit(x.window_start))).select("latency_ms").collect()]
        for p in (50, 95, 99):
            assert abs(np.mean(np.array(own) <= x[f"p{p}"]) - p / 100) < 0.02
    few = O.sketch_health(O.latency_sketches(raw.where("id < 50"), "1 day")).collect()  # of few rows a sketch is exact
    low = sorted(r[0] for r in raw.where("id < 50").select("latency_ms").collect())
    assert sum(x.n for x in few) == 50 and (len(few) > 1 or few[0].p50 == pytest.approx(low[24], abs=1e-5))


def test_late_rows_are_dropped(spark, tmp_path):
    """Rows behind the watermark are missing from their window, and from that one only."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    kind = "event_id long, ts timestamp, user_id long, latency_ms double, fallback int, failed int"
    steps = [[(0, 0), (1, 0.5), (2, 1)], [(3, 30), (4, 0.2)], [(5, 29), (6, 0.1), (7, 28)], [(8, 60)], [(9, 90)]]
    for rows in steps:
        spark.createDataFrame([(i, at(m), 1, 5.0, 0, 0) for i, m in rows], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = health.read_requests(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        q = health.rolling_health(stream, "5 minutes", late="2 minutes").writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = {x.window_start: x.n for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    # Row 4 came with the row that moved the watermark, which moves after a batch; rows 6 came later, 7 and 5 in time.
    assert got == {at(0): 4, at(25): 2, at(30): 1, at(60): 1}
