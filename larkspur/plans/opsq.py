"""Queries over text, statistics, drift, operations and registries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions.vectors import cosine
from larkspur.operators import ops as O
from larkspur.operators import stats as S
from larkspur.plans import views as V
from larkspur.plans.registry import query
from larkspur.session import table
from larkspur.sources.shared import Scratch
from larkspur.streaming.runs import closed_runs

POSITIVE, NEGATIVE = ["the", "and", "with", "for"], ["that", "this", "not", "from"]


def _n(words):
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)


@query("x2_normalize_name", "SELECT p_partkey AS product_id, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS name FROM part")
def x2(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), T.normalize_name(F.col("p_name")).alias("name"))


@query("x3_tags", "SELECT p_partkey AS product_id, coalesce(nullif(concat_ws(',', CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'copper') THEN 'metal' END, CASE WHEN contains(lower(p_type), 'small') THEN 'size' END), ''), 'all') AS tags FROM part")
def x3(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), T.tags(F.col("p_type"), {"metal": ["steel", "copper"], "size": ["small"]}, "all").alias("tags"))


@query("x4_labelled_text", "SELECT p_partkey AS product_id, concat('name: ', coalesce(nullif(trim(p_name), ''), 'unknown'), ' [SEP] brand: ', coalesce(nullif(trim(p_brand), ''), 'unknown')) AS text FROM part")
def x4(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), T.labelled_text({"name": F.col("p_name"), "brand": F.col("p_brand")}).alias("text"))


@query("x5_keyword_sentiment", f"SELECT doc_id, round(CAST(CASE n WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 ELSE least(0.8 + 0.05 * (n - 3), 1.0) END AS DOUBLE), 6) AS score FROM (SELECT doc_id, {_n(POSITIVE)} AS n FROM documents)")
def x5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.keyword_sentiment(F.col("text"), POSITIVE), 6).alias("score"))


_ADJ = f"""WITH b AS (SELECT d.doc_id, d.text, CAST(1 + d.doc_id % 5 AS DOUBLE) AS rating, CAST(len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda w: w <> '')) AS DOUBLE) AS words, {_n(POSITIVE)} AS pos, {_n(NEGATIVE)} AS neg, CAST(d.doc_id % 900 AS DOUBLE) AS age FROM documents d),
u AS (SELECT *, CASE WHEN length(regexp_replace(lower(text), '\\s', '', 'g')) > 0 THEN len(list_distinct(string_split(regexp_replace(lower(text), '\\s', '', 'g'), ''))) / length(regexp_replace(lower(text), '\\s', '', 'g')) ELSE 1 END AS uniq FROM b),
q AS (SELECT *, 0.5 + CASE WHEN words >= 25 THEN least(0.02 + 0.002 * (words - 25), 0.06) ELSE 0 END - CASE WHEN words <= 4 AND rating >= 4 THEN 0.08 ELSE 0 END + least(0.015 * pos, 0.05) - least(0.02 * neg, 0.08) AS a FROM u)
SELECT doc_id, round(least(greatest(a * CASE WHEN rating >= 4 AND neg > pos THEN 0.88 WHEN rating <= 2 AND pos > neg THEN 0.928 ELSE 1 END * (0.65 + 0.35 * exp(-age / 365)) * CASE WHEN uniq < 0.35 THEN 0.88 ELSE 1 END, 0), 1), 6) AS quality,
CAST((words <= 4 AND rating >= 4) OR (rating >= 4 AND neg > pos) OR (rating <= 2 AND pos > neg) OR uniq < 0.35 AS INTEGER) AS suspicious FROM q"""


@query("x7_adjusted_quality", _ADJ)
def x7(spark, d):
    as_of = F.lit("2024-06-01").cast("date")
    docs = table(spark, d, "documents").withColumns({"rating": (1 + F.col("doc_id") % 5).cast("double"), "ts": F.date_sub(as_of, (F.col("doc_id") % 900).cast("int"))})
    q = T.adjusted_quality(F.lit(0.5), F.col("text"), F.col("rating"), F.col("ts"), as_of, POSITIVE, NEGATIVE)
    return docs.select("doc_id", q.alias("q")).select("doc_id", F.round("q.quality", 6).alias("quality"), "q.suspicious")


@query("x12_preview", "SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview FROM conversations")
def x12(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.preview(F.col("text")).alias("preview"))


@query("f16_review_grep", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)license')) AS INTEGER) AS matches FROM documents WHERE regexp_matches(text, '(?i)license')")
def f16(spark, d):
    return table(spark, d, "documents").select("doc_id", T.grep(F.col("text"), "license").alias("matches")).where("matches > 0")


@query(
    "f16_match_spans",
    """WITH f AS (SELECT doc_id, regexp_extract_all(text, '(?i)licen[cs]e\\w*') AS m, regexp_split_to_array(text, '(?i)licen[cs]e\\w*') AS b FROM documents),
u AS (SELECT doc_id, unnest(m) AS match, unnest(list_transform(m, lambda x, i: length(b[i]))) AS gap, generate_subscripts(m, 1) AS k FROM f)
SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(sum(gap + length(match)) OVER w - length(match) AS INTEGER) AS start, CAST(sum(gap + length(match)) OVER w AS INTEGER) AS "end", match FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY k)""",
)
def f16_spans(spark, d):
    """Every match of a pattern with its place in the text."""
    return T.matches(table(spark, d, "documents").select("doc_id", "text"), "text", r"licen[cs]e\w*", "regex").select("doc_id", "k", "start", "end", "match")


@query("x12_highlights", "SELECT doc_id, regexp_replace(text, '(?i)(license)', '[\\1]', 'g') AS marked FROM documents WHERE regexp_matches(text, '(?i)license')")
def x12_marks(spark, d):
    docs = table(spark, d, "documents").where(T.grep(F.col("text"), "license") > 0)
    return docs.select("doc_id", T.highlight(F.col("text"), "license").alias("marked"))


@query("x11_version_parts", "SELECT p_partkey AS id, 'als' AS model, CAST(p_size AS INTEGER) AS major, CAST(p_partkey % 7 AS INTEGER) AS minor FROM part")
def x11(spark, d):
    name = F.concat(F.lit("als_v"), F.col("p_size"), F.lit("."), F.col("p_partkey") % 7)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.version_parts(name).alias("v")).select("id", "v.*")


# Statistics: per-customer spend in two halves of the orders as paired samples.
PAIRS = "pairs AS (SELECT o_custkey AS id, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) AS a, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) AS b FROM orders GROUP BY o_custkey), pr AS (SELECT * FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL)"


def pairs(spark, d):
    # Sums of decimals don't depend on the order of rows, so that equal orders give equal means, and differences tie.
    own = lambda k: F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice").cast("decimal(24,8)"))
    half = lambda k: F.sum(own(k)).cast("double") / F.nullif(F.count(own(k)), F.lit(0))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(half(0).alias("a"), half(1).alias("b")).dropna()


@query("d1_paired_t", f"WITH {PAIRS} SELECT count(*) AS n, round(avg(a - b), 4) AS mean, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM pr")
def d1(spark, d):
    x = pairs(spark, d).withColumn("d", F.col("a") - F.col("b")).agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    return x.select("n", F.round("m", 4).alias("mean"), F.round(F.col("m") / (F.col("s") / F.sqrt("n")), 6).alias("t"))


@query("d2_wilcoxon", f"WITH {PAIRS}, d AS (SELECT a - b AS d, round(abs(a - b), 9) AS m FROM pr WHERE a <> b), c AS (SELECT m, count(*) AS k FROM d GROUP BY m), r AS (SELECT m, coalesce(sum(k) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS r FROM c), s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM d JOIN r USING (m)) SELECT n, w_plus, w_minus, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM s")
def d2(spark, d):
    return S.wilcoxon(pairs(spark, d), "a", "b")


@query("d2_wilcoxon_ties", f"WITH {PAIRS}, d AS (SELECT round(a - b, -4) AS d FROM pr WHERE round(a - b, -4) <> 0), c AS (SELECT abs(d) AS m, count(*) AS k FROM d GROUP BY 1), r AS (SELECT m, k, coalesce(sum(k) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS r FROM c) SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, CAST((SELECT sum(k * k * k - k) FROM c) AS BIGINT) AS ties FROM d JOIN r ON m = abs(d)")
def d2_ties(spark, d):
    """Rank sums of differences in whole ten thousands, of which many tie."""
    rounded = pairs(spark, d).select(F.round(F.col("a") - F.col("b"), -4).alias("a"), F.lit(0.0).alias("b"))
    return S.wilcoxon_sums(rounded, "a", "b")


@query("d2_wilcoxon_p")
def d2_p(spark, d):
    found = [(name, *(float(x) for x in S.wilcoxon_test(pairs(spark, d), "a", "b", name).values())) for name in ("two-sided", "greater", "less")]
    return spark.createDataFrame(found, "alternative string, n double, statistic double, p double")


@query("d3_effect_sizes", f"WITH {PAIRS} SELECT round(avg(a - b) / stddev_samp(a - b), 6) AS paired_d, round(avg(a - b) / sqrt((var_samp(a) + var_samp(b)) / 2), 6) AS pooled_d, round(avg(a - b) / stddev_samp(b), 6) AS glass_delta FROM pr")
def d3(spark, d):
    return S.effect_sizes(pairs(spark, d), "a", "b")


_P = "p AS (SELECT label, (label * 37 % 101) / 2000.0 AS p FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL))"


@query("d6_corrections", f"WITH {_P}, k AS (SELECT label, CAST(p AS DOUBLE) AS p, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS k FROM p), s AS (SELECT *, min(CAST(p <= 0.05 / (m - k + 1) AS INTEGER)) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS holm_reject FROM k) SELECT label, round(p, 6) AS p, round(least(p * m, 1), 6) AS bonferroni_p, round(least(p * (m - k + 1), 1), 6) AS holm_p, holm_reject FROM s")
def d6(spark, d):
    p = table(spark, d, "embeddings").where("label is not null").select("label").distinct().withColumn("p", (F.col("label") * 37 % 101).cast("double") / 2000)
    return S.corrected(p, "p").withColumns({c: F.round(c, 6) for c in ("p", "bonferroni_p", "holm_p")})


@query("d11_ks_drift", "WITH x AS (SELECT value AS x, CAST(event_id % 2 = 0 AS INTEGER) AS a FROM events), s AS (SELECT x, sum(a) AS a, sum(1 - a) AS b FROM x GROUP BY x), r AS (SELECT sum(a) OVER w AS ra, sum(b) OVER w AS rb, (SELECT sum(a) FROM s) AS na, (SELECT sum(b) FROM s) AS nb FROM s WINDOW w AS (ORDER BY x)) SELECT CAST(any_value(na) AS BIGINT) AS n_a, CAST(any_value(nb) AS BIGINT) AS n_b, round(max(abs(ra / na - rb / nb)), 6) AS d FROM r")
def d11(spark, d):
    e = table(spark, d, "events")
    return S.ks_statistic(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "value")


@query("d12_popularity_shift", f"WITH {V.INTER}, a AS (SELECT product_id, count(*) FILTER (WHERE rid % 2 = 0) AS a, count(*) FILTER (WHERE rid % 2 = 1) AS b FROM inter GROUP BY product_id), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM a) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r")
def d12(spark, d):
    x = V.interactions(spark, d).groupBy("product_id").agg(F.count_if(F.col("rid") % 2 == 0).alias("a"), F.count_if(F.col("rid") % 2 == 1).alias("b"))
    return S.spearman(x, "a", "b")


@query("d13_activity_drift", f"WITH {V.INTER}, o AS (SELECT user_id, count(*) AS n FROM inter WHERE rid % 3 <> 0 GROUP BY user_id), w AS (SELECT user_id, count(*) AS n FROM inter WHERE rid % 3 = 0 GROUP BY user_id), m AS (SELECT avg(o.n) AS a, avg(w.n) AS b, count(*) FILTER (WHERE o.n IS NOT NULL AND w.n IS NOT NULL) AS returned, count(*) FILTER (WHERE o.n IS NULL) AS brand_new FROM o FULL JOIN w ON o.user_id = w.user_id) SELECT round(a, 6) AS old_mean, round(b, 6) AS new_mean, round(abs(b - a) / a, 6) AS change, CAST(abs(b - a) / a > 0.2 AS INTEGER) AS drift, returned, brand_new FROM m")
def d13(spark, d):
    x = V.interactions(spark, d)
    return S.activity_drift(x.where("rid % 3 <> 0"), x.where("rid % 3 = 0"))


@query("d14_embedding_drift", "SELECT count(*) AS n, count(*) FILTER (WHERE c < 0.95) AS moved, round(avg(c), 6) AS mean FROM (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + a.vec_id % 2)")
def d14(spark, d):
    v = V.vectors(spark, d)
    both = v.select((F.col("id") + F.col("id") % 2).alias("id"), F.col("vec").alias("old")).join(v.select("id", "vec"), "id")
    return both.select(cosine(F.col("old"), F.col("vec")).alias("c")).agg(F.count("*").alias("n"), F.count_if(F.col("c") < 0.95).alias("moved"), F.round(F.avg("c"), 6).alias("mean"))


# Operations.
@query("a35_health_rollup", f"WITH {V.REQUESTS}, l AS (SELECT date_trunc('minute', ts) AS window_start, count(*) AS n, avg(latency_ms) AS a, avg(fallback) AS f, avg(failed) AS e, list_sort(list(latency_ms)) AS l FROM requests GROUP BY 1) SELECT window_start, n, round(a, 6) AS avg_latency, round(f, 6) AS fallback_rate, round(e, 6) AS error_rate, round(l[least(CAST(floor(n * 0.5) AS INTEGER) + 1, n)], 6) AS p50, round(l[least(CAST(floor(n * 0.95) AS INTEGER) + 1, n)], 6) AS p95, round(l[least(CAST(floor(n * 0.99) AS INTEGER) + 1, n)], 6) AS p99 FROM l")
def a35(spark, d):
    return O.health_rollup(V.requests(spark, d))


_WIDTHS = {"15 minutes": 900, "1 hour": 3600, "6 hours": 21_600, "1 day": 86_400}


@query(
    "a35_sketch_rollup",
    f"WITH {V.REQUESTS} " + " UNION ALL ".join(f"SELECT '{name}' AS width, make_timestamp((epoch_us(ts) // {s}000000) * {s}000000) AS window_start, count(*) AS n, round(sum(latency_ms) / count(*), 6) AS avg_latency, round(avg(fallback), 6) AS fallback_rate, round(avg(failed), 6) AS error_rate, true AS within FROM requests GROUP BY 2" for name, s in _WIDTHS.items()),
)
def a35_sketches(spark, d):
    """Sketches of a minute rolled up to wider windows, each from the one before; `within`: the raw latencies have the
    sketch's percentiles within 3 % of their ranks."""
    raw = V.requests(spark, d)
    held, out = Scratch(spark, "sketches").write(O.latency_sketches(raw), "minutes"), None
    for name in _WIDTHS:
        held = O.roll_up(held, name)
        health = O.sketch_health(held)
        real = raw.select(F.window("ts", name)["start"].alias("window_start"), "latency_ms").join(health.select("window_start", "p50", "p95", "p99"), "window_start")
        low = lambda p: F.count_if(F.col("latency_ms") < F.col(p) - 1e-6) / F.count("*")
        high = lambda p: F.count_if(F.col("latency_ms") <= F.col(p) + 1e-6) / F.count("*")
        near = lambda p: (low(f"p{p}") <= p / 100 + 0.03) & (high(f"p{p}") >= p / 100 - 0.03)
        ok = real.groupBy("window_start").agg((near(50) & near(95) & near(99)).alias("within"))
        part = health.join(ok, "window_start").select(F.lit(name).alias("width"), "window_start", "n", "avg_latency", "fallback_rate", "error_rate", "within")
        out = part if out is None else out.unionByName(part)
    return out


_RUNS = """events_ AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, o_orderpriority AS pipeline, 'running' AS status, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), NULL, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'success' END, CAST(l_shipdate AS TIMESTAMP) FROM lineitem)"""


@query(
    "st_closed_runs",
    f"""WITH {_RUNS}, r AS (SELECT run_id, min(pipeline) AS pipeline, min(ts) FILTER (WHERE status = 'running') AS started, min(ROW(ts, status)) FILTER (WHERE status <> 'running') AS e FROM events_ GROUP BY run_id),
c AS (SELECT *, e IS NULL OR e[1] > started + INTERVAL 720 HOUR AS stale FROM r WHERE started IS NOT NULL)
SELECT run_id, pipeline, started, CASE WHEN stale THEN started + INTERVAL 720 HOUR ELSE e[1] END AS finished, CASE WHEN stale THEN 'failed' ELSE e[2] END AS status, CASE WHEN stale THEN 'Marked as stale - exceeded max running time' END AS error FROM c""",
)
def st_closed_runs(spark, d):
    """Orders as runs that end with their first shipment, or are stale after thirty days: what the stream of them closes."""
    started = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_orderpriority").alias("pipeline"), F.lit("running").alias("status"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    ended = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), F.lit(None).cast("string").alias("pipeline"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("success").alias("status"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return closed_runs(started.unionByName(ended), 720)


@query("a36_request_stats", f"WITH {V.REQUESTS} SELECT count(*) AS n, round(avg(latency_ms), 6) AS avg_latency, round(avg(fallback), 6) AS fallback_rate, round(quantile_cont(latency_ms, 0.95), 6) AS p95, CAST(coalesce(sum(failed), 0) AS BIGINT) AS errors FROM requests WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1440 MINUTE")
def a36(spark, d):
    return O.request_stats(V.requests(spark, d), F.lit("2024-01-20").cast("timestamp"), 1440)


@query("a40_load_summary", f"WITH {V.REQUESTS} SELECT event_type, count(*) AS n, round(avg(latency_ms), 6) AS mean, round(quantile_cont(latency_ms, 0.5), 6) AS median, round(quantile_cont(latency_ms, 0.9), 6) AS p90, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, round(100 * avg(CAST(latency_ms <= 50 AS DOUBLE)), 6) AS compliance_pct FROM requests GROUP BY event_type")
def a40(spark, d):
    return O.load_summary(V.requests(spark, d), 50, "event_type")


@query("a37_dashboard_kpis", f"WITH {V.REQUESTS} SELECT count(*) AS n, round(avg(latency_ms), 6) AS mean, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(avg(fallback), 6) AS fallback_rate, round(avg(failed), 6) AS error_rate FROM requests")
def a37(spark, d):
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return V.requests(spark, d).agg(F.count("*").alias("n"), r6(F.avg("latency_ms"), "mean"), r6(F.percentile("latency_ms", F.lit(0.95)), "p95"), r6(F.avg("fallback"), "fallback_rate"), r6(F.avg("failed"), "error_rate"))


_RUNS = "runs AS (SELECT o_orderkey AS run_id, CASE o_custkey % 3 WHEN 0 THEN 'refresh' WHEN 1 THEN 'train' ELSE 'deploy' END AS pipeline, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS started, o_totalprice / 1000 AS seconds FROM orders)"


def runs(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_custkey") % 3
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.when(k == 0, "refresh").when(k == 1, "train").otherwise("deploy").alias("pipeline"),
        F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("running").alias("status"), F.col("o_orderdate").alias("started"), (F.col("o_totalprice") / 1000).alias("seconds"),
    )


@query("a38_pipeline_stats", f"WITH {_RUNS} SELECT pipeline, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'running') AS running, round(avg(seconds), 6) AS avg_seconds, round(count(*) FILTER (WHERE status = 'success') / nullif(count(*) FILTER (WHERE status <> 'running'), 0), 6) AS success_rate FROM runs GROUP BY pipeline")
def a38(spark, d):
    x = runs(spark, d)
    counts = x.groupBy("pipeline").pivot("status", ["success", "failed", "running"]).count().na.fill(0)
    out = counts.join(x.groupBy("pipeline").agg(F.round(F.avg("seconds"), 6).alias("avg_seconds")), "pipeline")
    return out.withColumn("success_rate", F.round(F.try_divide("success", F.col("success") + F.col("failed")), 6))


@query("a39_daily_success", f"WITH {_RUNS} SELECT CAST(CAST(started AS DATE) AS VARCHAR) AS day, pipeline, count(*) AS n, round(avg(CAST(status = 'success' AS DOUBLE)), 6) AS success_rate FROM runs GROUP BY 1, 2")
def a39(spark, d):
    return runs(spark, d).groupBy(F.to_date("started").cast("string").alias("day"), "pipeline").agg(F.count("*").alias("n"), F.round(F.avg((F.col("status") == "success").cast("double")), 6).alias("success_rate"))


@query("d17_alerts", f"WITH {V.REQUESTS}, m AS (SELECT 'error_rate' AS metric, avg(failed) AS value FROM requests UNION ALL SELECT 'avg_latency', avg(latency_ms) FROM requests UNION ALL SELECT 'requests', count(*) FROM requests) SELECT 'high_errors' AS name, metric, round(value, 6) AS value, CAST(0.05 AS DOUBLE) AS threshold, 'critical' AS severity FROM m WHERE metric = 'error_rate' AND value > 0.05 UNION ALL SELECT 'slow', metric, round(value, 6), CAST(10 AS DOUBLE), 'warning' FROM m WHERE metric = 'avg_latency' AND value > 10 UNION ALL SELECT 'low_requests', metric, round(value, 6), CAST(5 AS DOUBLE), 'warning' FROM m WHERE metric = 'requests' AND value < 5")
def d17(spark, d):
    row = V.requests(spark, d).agg(F.avg("failed").alias("error_rate"), F.avg("latency_ms").alias("avg_latency"), F.count("*").cast("double").alias("requests"))
    metrics = row.unpivot([], row.columns, "metric", "value")
    rules = spark.createDataFrame([("high_errors", "error_rate", 0.05, "critical", ">"), ("slow", "avg_latency", 10.0, "warning", ">"), ("low_requests", "requests", 5.0, "warning", "<")], "name string, metric string, threshold double, severity string, direction string")
    return O.alerts(metrics, rules).withColumn("value", F.round("value", 6))


_CHECKS = f"{_RUNS}, checks AS (SELECT pipeline, run_id, CASE status WHEN 'failed' THEN 'critical' WHEN 'running' THEN 'warning' ELSE 'ok' END AS status FROM runs)"


@query("d18_health_check", f"WITH {_CHECKS} SELECT pipeline, CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'ok' END AS status, count(*) FILTER (WHERE status <> 'ok') AS problems FROM checks GROUP BY pipeline")
def d18(spark, d):
    status = F.when(F.col("status") == "failed", "critical").when(F.col("status") == "running", "warning").otherwise("ok")
    return O.worst_status(runs(spark, d).withColumn("status", status), ["pipeline"])


MODELS = "models AS (SELECT p_partkey AS model_id, p_brand AS model_type, CASE WHEN p_partkey % 4 = 0 THEN 'archived' ELSE 'active' END AS status, p_size AS created, p_retailprice / 10000 AS recall FROM part)"


def models(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("model_id"), F.col("p_brand").alias("model_type"), F.when(F.col("p_partkey") % 4 == 0, "archived").otherwise("active").alias("status"), F.col("p_size").alias("created"), (F.col("p_retailprice") / 10000).alias("recall"))


@query("g2_select_best", f"WITH {MODELS} SELECT model_type, model_id, round(recall, 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY recall DESC NULLS LAST, model_id) AS k FROM models WHERE status = 'active') WHERE k = 1")
def g2(spark, d):
    return O.select_best(models(spark, d), "recall", ["model_type"]).select("model_type", "model_id", F.round("recall", 6).alias("recall"))


@query("g1_latest_state", f"WITH {_RUNS} SELECT pipeline, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY started DESC, run_id DESC) AS k FROM runs) WHERE k = 1")
def g1(spark, d):
    return O.latest(runs(spark, d), "pipeline", "started", "run_id").select("pipeline", "run_id", "status")


_DEPLOYS = f"{_RUNS}, ev AS (SELECT pipeline, run_id, run_id % 97 AS model_id, CASE WHEN run_id % 5 = 0 THEN 'rollback' ELSE 'deploy' END AS action, started FROM runs)"


def deployments(spark, d):
    return runs(spark, d).select("pipeline", "run_id", (F.col("run_id") % 97).alias("model_id"), F.when(F.col("run_id") % 5 == 0, "rollback").otherwise("deploy").alias("action"), "started")


@query("g9_deployment_history", f"WITH {_DEPLOYS} SELECT pipeline, run_id, model_id, action, previous, CAST(age AS INTEGER) AS age FROM (SELECT *, lag(model_id) OVER (PARTITION BY pipeline ORDER BY started, run_id) AS previous, row_number() OVER (PARTITION BY pipeline ORDER BY started DESC, run_id DESC) AS age FROM ev) WHERE age <= 100")
def g9(spark, d):
    return O.deployment_history(deployments(spark, d), "pipeline", "started", "run_id").select("pipeline", "run_id", "model_id", "action", "previous", "age")


@query("g9_rollback", f"WITH {_DEPLOYS}, h AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY started DESC, run_id DESC) AS age FROM ev), c AS (SELECT pipeline, model_id AS current FROM h WHERE age = 1) SELECT pipeline, arg_min(model_id, age) AS model_id, 'rollback' AS action FROM h JOIN c USING (pipeline) WHERE age <= 100 AND model_id <> current GROUP BY pipeline")
def g9b(spark, d):
    return O.rollback(O.deployment_history(deployments(spark, d), "pipeline", "started", "run_id"), "pipeline")


@query("w14_retention", f"WITH {MODELS}, b AS (SELECT model_id FROM models WHERE status = 'active' ORDER BY recall DESC NULLS LAST, model_id LIMIT 1) SELECT model_id, model_type, CAST(k AS INTEGER) AS age_rank FROM (SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY created DESC, model_id) AS k FROM models) WHERE k > 2 AND model_id NOT IN (SELECT model_id FROM b)")
def w14(spark, d):
    return O.retention(models(spark, d), "model_type", "created", 2, "recall").select("model_id", "model_type", "age_rank")


@query("a41_registry_stats", f"WITH {MODELS} SELECT model_type, status, count(*) AS n, round(max(recall), 6) AS best FROM models GROUP BY model_type, status")
def a41(spark, d):
    return models(spark, d).groupBy("model_type", "status").agg(F.count("*").alias("n"), F.round(F.max("recall"), 6).alias("best"))


@query("z1_compare_filters", "SELECT p_partkey AS id, concat_ws(',', CASE WHEN p_size % 3 <> p_size % 2 THEN 'least' END, 'most', CASE WHEN p_size % 2 = 1 THEN 'only_a' END) AS changed FROM part")
def z1(spark, d):
    size = F.col("p_size")
    a = F.map_from_entries(F.filter(F.array(F.struct(F.lit("least").alias("k"), (size % 3).alias("v")), F.struct(F.lit("most").alias("k"), F.lit(1).alias("v")), F.when(size % 2 == 1, F.struct(F.lit("only_a").alias("k"), F.lit(1).alias("v")))), lambda x: x.isNotNull()))
    b = F.create_map(F.lit("least"), size % 2, F.lit("most"), F.lit(2))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), O.compare_maps(a, b).alias("changed"))


@query("y1_staleness", "SELECT o_orderkey AS id, datediff('day', o_orderdate, TIMESTAMP '1999-01-01') AS age_days, CAST(datediff('day', o_orderdate, TIMESTAMP '1999-01-01') > 400 AS INTEGER) AS stale FROM orders")
def y1(spark, d):
    age = F.datediff(F.lit("1999-01-01").cast("date"), "o_orderdate").cast("bigint")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), age.alias("age_days"), (age > 400).cast("int").alias("stale"))


@query("w13_latest_by_group", "SELECT o_custkey AS user_id, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey")
def w13(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc())
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("latest"))


@query("st_sliding_health", f"WITH {V.REQUESTS}, w AS (SELECT unnest([0, 1, 2, 3, 4]) AS k) SELECT date_trunc('minute', ts) - to_minutes(k) AS window_start, count(*) AS n, round(avg(failed), 6) AS error_rate FROM requests, w GROUP BY 1")
def sliding(spark, d):
    return O.health_rollup(V.requests(spark, d), "5 minutes", "1 minute").select("window_start", "n", "error_rate")


@query("st_sessions", f"WITH {V.REQUESTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM requests), i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM i GROUP BY user_id, sid")
def st_sessions(spark, d):
    out = V.requests(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), "n")


@query("a27_content_hash")
def a27(spark, d):
    return O.content_hash(table(spark, d, "orders"))


@query("d9_bootstrap")
def d9(spark, d):
    return S.bootstrap(pairs(spark, d), "a", 100, key="id")


@query("d10_permutation")
def d10(spark, d):
    return S.permutation_p(pairs(spark, d), "a", "b", 100, key="id")
