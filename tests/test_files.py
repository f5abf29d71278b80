"""Files of other tools: round trips, bad files, conditions, and keywords from corrections."""

import datetime as dt
import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.sources import files, writers


def test_npy(spark, tmp_path):
    r = np.random.default_rng(1)
    m, v = r.normal(size=(25_000, 3)), r.integers(0, 9, 7)
    np.save(tmp_path / "a.npy", m.astype(np.float32))
    np.save(tmp_path / "b.npy", v)
    got = files.read_npy(spark, f"{tmp_path}/*.npy")
    a = np.array([x.vec for x in got.where("path LIKE '%a.npy'").orderBy("id").collect()])
    assert a == pytest.approx(m.astype(np.float32).astype(float)) and [x.vec for x in got.where("path LIKE '%b.npy'").orderBy("id").collect()] == [[float(x)] for x in v]
    np.save(tmp_path / "c.npy", np.array([{"a": 1}], object))
    with pytest.raises(Exception, match="pickle"):
        files.read_npy(spark, f"{tmp_path}/c.npy").collect()


def test_save_npy(spark, tmp_path):
    df = spark.range(23_456).select((F.col("id") * 7 % 23_456).alias("i")).withColumn("n", F.col("i") / 2).repartition(5)
    files.save_npy(df, "i", "n", f"{tmp_path}/n.npy")
    assert (np.load(tmp_path / "n.npy") == np.arange(23_456) / 2).all()
    files.save_npy(df.select("i", F.array("n", "i").alias("v")).limit(0), "i", "v", f"{tmp_path}/none.npy")
    files.save_npy(df.select("i", F.array("n", F.col("i").cast("double")).alias("v")), "i", "v", f"{tmp_path}/v.npy")
    assert np.load(tmp_path / "none.npy").shape[0] == 0 and np.load(tmp_path / "v.npy").shape == (23_456, 2)


@pytest.mark.parametrize("kind", ["csr", "csc"])
def test_sparse(spark, tmp_path, kind):
    r = np.random.default_rng(2)
    dense = r.random((40, 30)) * (r.random((40, 30)) < 0.1)
    by = dense if kind == "csr" else dense.T
    starts = np.concatenate([[0], np.cumsum((by > 0).sum(axis=1))])
    np.savez(tmp_path / "m.npz", data=by[by > 0], indices=np.nonzero(by)[1], indptr=starts, shape=dense.shape, format=np.array(kind.encode()))
    got = {(x.row, x.col): x.value for x in files.read_csr(spark, f"{tmp_path}/m.npz").collect()}
    assert got == {(int(i), int(j)): dense[i, j] for i, j in zip(*np.nonzero(dense), strict=True)}


def test_sqlite(spark, tmp_path):
    for k in range(2):
        with sqlite3.connect(tmp_path / f"{k}.db") as db:
            db.execute("CREATE TABLE requests (id INTEGER, at TEXT, ms REAL, note TEXT)")
            db.executemany("INSERT INTO requests VALUES (?, ?, ?, ?)", [(i + 100 * k, f"2024-01-01 00:{i:02d}:00", i / 2 if i else "x", None if i % 2 else "é") for i in range(30)])
        db.close()
    schema = "id long, at timestamp, ms double, note string"
    got = files.read_sqlite(spark, f"{tmp_path}/*.db", "requests", schema, "id % 100 < 20")
    assert got.count() == 40 and got.where("id = 3").first() == (3, dt.datetime(2024, 1, 1, 0, 3), 1.5, None) and got.where("id = 100").first().ms is None
    last = files.since(got, "at", F.lit("2024-01-01 00:15:00").cast("timestamp"), 10)
    assert [r.id % 100 for r in last.collect()][::2] == list(range(15, 5, -1))
    with pytest.raises(ValueError, match="names"):
        files.read_sqlite(spark, f"{tmp_path}/*.db", "requests; DROP", schema)


def test_keywords_from_corrections(spark, tmp_path):
    for k, x in enumerate([{"gud ": "very Good", "": "good", "bda": "bad", "ok": ""}, {"gooood": "good and bad", "zz": "neutral"}]):
        (tmp_path / f"corrected_chunk_{k}.json").write_text(json.dumps(x))
    got = files.corrected_keywords(spark, f"{tmp_path}/corrected_chunk_*.json", {"up": ["Nice", "gud"], "down": ["awful"]}, {"up": ["good"], "down": ["bad"]})
    assert sorted(map(tuple, got.collect())) == [("down", "awful"), ("down", "bda"), ("down", "gooood"), ("up", "gooood"), ("up", "gud"), ("up", "nice")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", 20), (1, "a", 30), (3, "c", 20)], "id int, name string, ts int")
    writers.report_json(df, f"{tmp_path}/r", ["id"])
    writers.export_registry(df, f"{tmp_path}/e", "ts", "id")
    assert [r.id for r in spark.read.json(f"{tmp_path}/r").collect()] == [1, 2, 3]
    assert [r.id for r in spark.read.option("header", True).csv(f"{tmp_path}/e").collect()] == ["2", "3", "1"]
    assert writers.report_markdown(df.orderBy("id")).splitlines()[2] == "| 1 | a | 30 |"


def test_whole_numbers(spark):
    """Numbers above 2^53 stay as they are; texts that are no whole number are cut or null."""
    from larkspur.operators.cleaning import to_long

    want = {"9007199254740993": 9007199254740993, " -12 ": -12, "3.0": 3, "9223372036854775807": 9223372036854775807, "92233720368547758070": None, "x": None, "": None, "1e3": 1000}
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", to_long(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == want
