"""Files of other tools as tables: .npy and .npz arrays, SQLite databases, keyword corrections; .npy as a sink.

A file is read whole by one task, by any path that Spark reads, so a single one is bounded by 2 GB; a folder or glob of
many files is read by many tasks. Larger tables are Parquet.
"""

from __future__ import annotations

import io
import re
import sqlite3
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.sources.readers import hadoop_path, read_json_maps

#: Rows of an output batch.
BATCH = 10_000


def _each_file(spark: SparkSession, path: str, schema: str, rows: Callable[[str, bytes], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield from rows(name, content)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, vec): the rows of .npy files, numbered from 0 in each; a vector's rows have one number. Pickled objects
    are refused."""

    def rows(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
        m = np.load(io.BytesIO(content), allow_pickle=False)
        m = m.reshape(len(m), -1).astype(float)
        for at in range(0, len(m), BATCH):
            part = m[at : at + BATCH]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), pa.array(list(part), pa.list_(pa.float64()))], ["path", "id", "vec"])

    return _each_file(spark, path, "path string, id long, vec array<double>", rows)


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value) of the stored cells of sparse matrices in .npz files with the arrays data, indices, indptr
    and shape: rows with their columns, or columns with their rows if the file's format says csc."""

    def rows(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
        with np.load(io.BytesIO(content), allow_pickle=False) as z:
            data, indices, starts = z["data"].astype(float), z["indices"].astype(np.int64), z["indptr"].astype(np.int64)
            kind = bytes(z["format"].item()).decode() if "format" in z.files else "csr"
        if kind not in ("csr", "csc"):
            raise ValueError(f"{name}: format {kind}")
        major = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        row, col = (major, indices) if kind == "csr" else (indices, major)
        for at in range(0, len(data), BATCH):
            cut = slice(at, at + BATCH)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(data[cut])), pa.array(row[cut]), pa.array(col[cut]), pa.array(data[cut])], ["path", "row", "col", "value"])

    return _each_file(spark, path, "path string, row long, col long, value double", rows)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, where: str | None = None) -> DataFrame:
    """Rows of a table of SQLite files, with the columns of schema (names and types); where is a condition in SQLite's SQL
    that the file's own engine applies. Timestamps are ISO texts, and values of another kind than the column's are nulls."""
    kinds = StructType.fromDDL(schema)
    texts = ", ".join(f"{f.name} string" for f in kinds)
    if not re.fullmatch(r"\w+", table) or not all(re.fullmatch(r"\w+", f.name) for f in kinds):
        raise ValueError("names of letters, digits and underscores only")
    query = f"SELECT {', '.join(f.name for f in kinds)} FROM {table}" + (f" WHERE {where}" if where else "")

    def rows(name: str, content: bytes) -> Iterator[pa.RecordBatch]:
        with sqlite3.connect(":memory:") as db:
            db.deserialize(content)
            found = db.execute(query)
            while part := found.fetchmany(BATCH):
                columns = [[None if v is None else str(v) for v in c] for c in zip(*part, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [f.name for f in kinds])

    return _each_file(spark, path, texts, rows).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds])


def since(df: DataFrame, ts: str, as_of: Column, minutes: int) -> DataFrame:
    """Rows of the last minutes before as_of, newest first."""
    return df.where((F.col(ts) > as_of - F.make_interval(mins=F.lit(minutes))) & (F.col(ts) <= as_of)).orderBy(F.desc(ts))


def corrected_keywords(spark: SparkSession, glob: str, keywords: dict[str, list[str]], roots: dict[str, list[str]]) -> DataFrame:
    """(bank, keyword): each bank's keywords in lower case, and every text of the correction maps in files of the glob
    (misspelling to spelling) whose spelling contains one of the bank's roots. Blank texts count for nothing."""
    given = spark.createDataFrame([(bank, w.lower()) for bank, words in keywords.items() for w in words], "bank string, keyword string")
    maps = read_json_maps(spark, glob).select(F.lower(F.trim("key")).alias("keyword"), F.lower(F.trim("value")).alias("spelling")).where("keyword <> '' AND spelling <> ''")
    out = given
    for bank, words in roots.items():
        has = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("spelling"), w))
        out = out.unionByName(maps.where(has).select(F.lit(bank).alias("bank"), "keyword"))
    return out.distinct()


def save_npy(df: DataFrame, order: str, value: str, path: str) -> None:
    """One .npy file of a column of numbers, or of arrays of one length, in the order of `order`. The driver passes on one
    partition at a time."""
    spark = df.sparkSession
    rows = df.select(order, value).orderBy(order)
    n, first = df.count(), df.select(value).first()
    width = len(first[0]) if first is not None and isinstance(first[0], list) else None
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, {"descr": "<f8", "fortran_order": False, "shape": (n,) if width is None else (n, width)})
    where, fs = hadoop_path(spark, path)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(head.getvalue()))
        part: list = []
        for r in rows.toLocalIterator():
            part.append(r[1])
            if len(part) == BATCH:
                stream.write(bytearray(np.array(part, "<f8").tobytes()))
                part = []
        stream.write(bytearray(np.array(part, "<f8").tobytes()))
    finally:
        stream.close()
