"""Tables of a job's own in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.readers import hadoop_path


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else what setCheckpointDir() was given; a local session without either gets a temporary one."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if named is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = context._jsc.sc().getCheckpointDir().get()
    return named


class Scratch:
    """A folder of written steps in the shared folder. Each step ends a lineage; drop() frees what isn't needed any more,
    and what is left goes when the session's file system closes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"
        where, fs = hadoop_path(spark, self.folder)
        fs.mkdirs(where)
        fs.deleteOnExit(where)

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{name}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        where, fs = hadoop_path(self.spark, f"{self.folder}/{name}")
        fs.delete(where, True)


def held(df: DataFrame) -> DataFrame:
    """df written once and read back, for what is read more than once; unlike a cache it needs no release and survives a
    lost executor."""
    return Scratch(df.sparkSession, "held").write(df, "rows")
