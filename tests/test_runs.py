"""Runs as a stream: equal to the batch over shuffled files, stale ones closed by a timer, late ends dropped."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larkspur.streaming import runs

EVENTS = "run_id string, pipeline string, status string, ts timestamp"
T = dt.datetime(2024, 3, 1)


def hour(h):
    return T + dt.timedelta(hours=h)


def _step(spark, tmp_path, late):
    """Takes what files there are, one at a time; returns all that was closed so far."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = runs.stream_closed_runs(stream, 24, late).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert q.awaitTermination(300) and q.exception() is None
    return spark.read.schema(runs.CLOSED).parquet(f"{tmp_path}/out")


def _add(spark, tmp_path, rows, files=1):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, EVENTS)
    df.repartition(files).write.mode("append").parquet(f"{tmp_path}/in")


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for k in range(40):
        rows.append((f"r{k}", f"p{k % 3}", "running", hour(k)))
        if k % 4 == 0:  # a repeated report of the same state
            rows.append((f"r{k}", f"p{k % 3}", "running", hour(k + 1)))
        if k % 5 != 3:
            rows.append((f"r{k}", f"p{k % 3}", ("success", "failed")[k % 2], hour(k + (2 if k % 7 else 30))))
    rows += [("orphan", "p0", "success", hour(5)), (None, "p0", "running", hour(1)), ("r1", "p1", "failed", hour(60)), ("end", "p9", "running", hour(400))]
    return spark.createDataFrame(rows, EVENTS)


def test_closed_runs(events):
    got = {r.run_id: r for r in runs.closed_runs(events).collect()}
    assert len(got) == 41 and "orphan" not in got
    assert (got["r1"].status, got["r1"].finished, got["r1"].error) == ("failed", hour(3), None)
    assert (got["r3"].status, got["r3"].finished, got["r3"].error) == ("failed", hour(27), runs.STALE)
    assert (got["r7"].status, got["r7"].finished) == ("failed", hour(31)) and got["r2"].status == "success"
    assert runs.closed_runs(events, as_of=F.lit(hour(27))).where("run_id = 'r3'").count() == 1
    assert runs.closed_runs(events, as_of=F.lit(hour(26))).where("run_id = 'r3'").isEmpty()


def test_stream_equals_batch(spark, events, tmp_path):
    """Events come in files in any order, all within the watermark; a last event then closes all that came before it."""
    _add(spark, tmp_path, events, 6)
    assert _step(spark, tmp_path, "500 hours").isEmpty()  # nothing is final while an event may still come
    _add(spark, tmp_path, [("later", "p", "running", hour(2000))])
    got = _step(spark, tmp_path, "500 hours")
    assert sorted(map(str, got.collect())) == sorted(map(str, runs.closed_runs(events, as_of=F.lit(hour(1500))).collect()))


def test_late_end_is_dropped(spark, tmp_path):
    """An end that comes behind the watermark doesn't count: its run is closed as stale."""
    _add(spark, tmp_path, [("a", "p", "running", hour(0)), ("b", "p", "running", hour(0)), ("b", "p", "success", hour(1))])
    _step(spark, tmp_path, "1 hour")
    _add(spark, tmp_path, [("c", "p", "running", hour(20))])
    _step(spark, tmp_path, "1 hour")
    _add(spark, tmp_path, [("a", "p", "success", hour(2)), ("c", "p", "success", hour(22))])
    _step(spark, tmp_path, "1 hour")
    _add(spark, tmp_path, [("d", "p", "running", hour(48))])
    got = {r.run_id: r for r in _step(spark, tmp_path, "1 hour").collect()}
    assert set(got) == {"a", "b", "c"}
    assert all((got[k].status, got[k].finished, got[k].error) == ("success", hour(h), None) for k, h in (("b", 1), ("c", 22)))
    assert (got["a"].status, got["a"].finished, got["a"].error) == ("failed", hour(24), runs.STALE)
