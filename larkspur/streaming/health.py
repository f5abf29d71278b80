"""Structured Streaming: rolling request health, alerts, sessions and an idempotent upsert sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_requests(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of request rows from Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a time zone; sessions run in UTC


def rolling_health(requests: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "2 minutes") -> DataFrame:
    """Counts, rates and approximate percentiles by tumbling or sliding window; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    p = F.percentile_approx("latency_ms", F.array(*map(F.lit, (0.5, 0.95, 0.99))), 10000)
    rows = requests.withWatermark("ts", late).groupBy(w.alias("w"))
    out = rows.agg(F.count("*").alias("n"), F.avg("latency_ms").alias("avg_latency"), F.avg("fallback").alias("fallback_rate"), F.avg("failed").alias("error_rate"), p.alias("p"))
    return out.select(F.col("w.start").alias("window_start"), "n", "avg_latency", "fallback_rate", "error_rate", *[F.col("p")[i].alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def windowed_alerts(requests: DataFrame, rules: list[tuple[str, str, float, str]], width: str = "5 minutes", slide: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """(window_start, rule, value, threshold, severity) of each window in which a rule (name, metric, threshold, severity) is exceeded."""
    health = rolling_health(requests, width, slide, late)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"), F.lit(s).alias("severity")) for n, m, t, s in rules])
    return health.select("window_start", F.explode(rows).alias("r")).where("r.value > r.threshold").select("window_start", "r.*")


def sessions(requests: DataFrame, gap: str = "30 minutes", late: str = "2 minutes") -> DataFrame:
    """(user_id, started, ended, n) of each user's sessions."""
    out = requests.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def without_repeats(requests: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_sink(stream: DataFrame, path: str, checkpoint: str, key: str = "window_start"):
    """Write each batch to its own folder under path, so that a repeated batch overwrites itself; read with read_upserts."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark: SparkSession, path: str, key: str = "window_start") -> DataFrame:
    """The latest row of each key that the sink wrote."""
    rows = spark.read.parquet(path)
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "_epoch").alias("r"))
    return best.select(key, "r.*").drop("_epoch", "batch")
