"""Round trips of sources and sinks, and streaming against batch."""

import os
import time

import pytest
from pyspark.sql import functions as F

from larkspur.operators import ops
from larkspur.plans import views
from larkspur.sources import readers, writers
from larkspur.streaming import health


def test_csv_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc', "é"), (2, None, "x,y")], "product_id int, product_name string, t string")
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/p")
    back = readers.read_csv(spark, f"{tmp_path}/p", "product_id int, product_name string, t string")
    assert sorted(back.collect()) == sorted(df.collect())
    assert readers.missing_columns(df, "interactions") == ["user_id", "rating", "cmt_date"]
    with pytest.raises(ValueError):
        readers.require_columns(df, "interactions")
    with pytest.raises(FileNotFoundError):
        readers.read_csvs(spark, str(tmp_path), {"products": "none.csv"})
    assert readers.first_existing(spark, [f"{tmp_path}/no", f"{tmp_path}/p"]).endswith("/p")


def test_versions_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.upsert(spark, df, f"{tmp_path}/u", "k", 1)
    writers.upsert(spark, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), f"{tmp_path}/u", "k", 2)
    assert dict(map(tuple, writers.read_versions(spark, f"{tmp_path}/u", "k").collect())) == {1: "a", 2: "c", 3: "d"}
    writers.save_version(df, f"{tmp_path}/v", "v1")
    with pytest.raises(Exception, match="(?i)exist"):
        writers.save_version(df, f"{tmp_path}/v", "v1")
    assert "| 1 | a |" in writers.report_markdown(df.orderBy("k"))
    assert writers.summary(spark, f"{tmp_path}/u").first()["files"] > 0
    one, two = ops.content_hash(df).first(), ops.content_hash(df.orderBy(F.desc("k"))).first()
    assert one == two


def test_backups(spark, tmp_path):
    a, b = (spark.createDataFrame([(i, x)], "k int, v string") for i, x in ((1, "a"), (2, "b")))
    writers.save_version(a, f"{tmp_path}/v", "v1")
    writers.save_version(b, f"{tmp_path}/v", "v2")
    listed = writers.versions(spark, f"{tmp_path}/v").collect()
    assert {r.version for r in listed} == {"v1", "v2"} and all(r.bytes > 0 for r in listed)
    writers.restore_version(spark, f"{tmp_path}/v", "v1", f"{tmp_path}/now")
    writers.restore_version(spark, f"{tmp_path}/v", "v2", f"{tmp_path}/now")
    assert spark.read.parquet(f"{tmp_path}/now").collect() == b.collect()
    with pytest.raises(FileNotFoundError):
        writers.restore_version(spark, f"{tmp_path}/v", "v3", f"{tmp_path}/now")


def test_bundle_mapping_and_hashes(spark, tmp_path):
    df = spark.createDataFrame([(10, 0), (30, 1), (20, 2)], "user_id long, u_idx int")
    writers.save_bundle({"one": df, "two": df.limit(1)}, f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b/one").count() == 3 and spark.read.parquet(f"{tmp_path}/b/two").count() == 1
    writers.save_mapping(df, "user_id", "u_idx", f"{tmp_path}/m")
    meta = spark.read.parquet(f"{tmp_path}/m/metadata").first()
    assert (meta.rows, meta.min_user_id, meta.max_user_id, meta.min_u_idx, meta.max_u_idx) == (3, 10, 30, 0, 2)
    assert meta.digest == ops.content_hash(spark.read.parquet(f"{tmp_path}/m/mapping")).first().digest
    (tmp_path / "f").mkdir()
    (tmp_path / "f/x.txt").write_text("abc")
    assert [r.md5 for r in writers.file_hashes(spark, f"{tmp_path}/f").collect()] == ["900150983cd24fb0d6963f7d28e17f72"]


def test_expired_files(spark, tmp_path):
    for name, days in (("new", 0), ("old", 10)):
        (tmp_path / name).write_text("x")
        os.utime(tmp_path / name, (time.time() - 86_400 * days,) * 2)
    assert [r.path.rsplit("/", 1)[-1] for r in writers.expired(spark, str(tmp_path), 5).collect()] == ["old"]


def test_encodings_and_json(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("product_id,name\n1,café\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_bytes("product_id,name\n1,café\n".encode())
    for name in ("latin", "utf"):
        assert readers.read_csv_any_encoding(spark, f"{tmp_path}/{name}.csv", "name").first().name == "café"
    (tmp_path / "a.json").write_text('{"x": "1", "y": "2"}')
    (tmp_path / "b.json").write_text('{"z": "3"}')
    assert {(r.key, r.value) for r in readers.read_json_maps(spark, f"{tmp_path}/*.json").collect()} == {("x", "1"), ("y", "2"), ("z", "3")}


def test_deployments(spark):
    events = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 6), ("b", 1, 9)], "pipeline string, ts int, model_id int")
    h = ops.deployment_history(events, "pipeline", "ts", "model_id")
    assert [(r.model_id, r.previous, r.age) for r in h.where("pipeline = 'a'").orderBy("age").collect()] == [(6, 6, 1), (6, 5, 2), (5, None, 3)]
    assert [tuple(r) for r in ops.rollback(h, "pipeline").collect()] == [("a", 5, "rollback")]  # b has nothing to go back to
    assert ops.deployment_history(events, "pipeline", "ts", "model_id", most=1).count() == 2


def test_pushdown(spark, sf_dir):
    df = readers.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey"], "l_returnflag = 'R'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan and "l_comment" not in plan


def _stream(spark, sf_dir, tmp_path):
    batch = views.requests(spark, sf_dir)
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    return batch, health.read_requests(spark, f"{tmp_path}/in", batch.schema)


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    batch, stream = _stream(spark, sf_dir, tmp_path)
    q = health.rolling_health(stream, late="365 days").writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("rolled").select("window_start", "n", F.round("error_rate", 6)).collect()
    assert sorted(got) == sorted(ops.health_rollup(batch).select("window_start", "n", "error_rate").collect())


def test_upsert_sink(spark, sf_dir, tmp_path):
    batch, stream = _stream(spark, sf_dir, tmp_path)
    q = health.upsert_sink(health.rolling_health(stream, late="365 days"), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(120)
    assert health.read_upserts(spark, f"{tmp_path}/out").agg(F.sum("n")).first()[0] == batch.count()


def test_alerts_and_sessions(spark, sf_dir, tmp_path):
    _, stream = _stream(spark, sf_dir, tmp_path)
    a = health.windowed_alerts(stream, [("errors", "error_rate", 0.5, "critical")], late="365 days")
    q = a.writeStream.outputMode("append").format("memory").queryName("alerts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    s = health.without_repeats(stream, late="365 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert spark.table("once").count() == spark.table("once").select("event_id").distinct().count()
