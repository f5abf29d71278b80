"""Helpers of the corpus operators: shared-folder writes, row keys, spans and their digests."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.session import table  # noqa: F401  (used by the query modules)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else what setCheckpointDir() was given.

    Where neither is set, a local session gets a new temporary folder, kept as its checkpoint folder. On a cluster that
    is an error: a folder of one machine would lose rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that may be broadcast: some tens of MB in memory.
SMALL_ROWS = 300_000


def small(df: DataFrame) -> DataFrame:
    """A written df of a few narrow columns, marked for broadcast if it has at most SMALL_ROWS rows; else as it is."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and a content hash. Rows alike in doc_id and text are one case with one result;
    the hash keeps rows apart that share a doc_id (or have none) but not their text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition on (doc_id, text_key), where a null doc_id meets a null doc_id."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


SPAN = "struct<start:int,end:int,value:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running results of an associative join over an array of ints: sums, maxima.

    Appending copies an array, so it is done in blocks of about the square root of the size: each block has running
    results of its own, and those of the blocks' last ones are joined on. Time grows with the power 1.5 of the size.
    """
    none = F.array().cast("array<int>")

    def within(block: Column) -> Column:
        start = F.struct(F.lit(None).cast("int").alias("last"), none.alias("out"))

        def step(acc, x):
            now = F.when(acc["last"].isNull(), x).otherwise(join(acc["last"], x)).cast("int")
            return F.struct(now.alias("last"), F.array_append(acc["out"], now).alias("out"))

        return F.aggregate(block, start, step, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda n: F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / n).cast("int") - 1), lambda k: within(F.slice(v, k * n + 1, n))))

    def joined(inner: Column) -> Column:
        # What each block is joined to: the running result of all blocks before it, none for the first.
        before = let(within(F.transform(inner, lambda x: F.element_at(x, -1))), lambda t: F.concat(F.array(F.lit(None).cast("int")), F.slice(t, 1, F.size(t) - 1)))
        return F.flatten(F.zip_with(inner, before, lambda x, o: F.when(o.isNull(), x).otherwise(F.transform(x, lambda v: join(o, v).cast("int")))))

    return F.when(F.size(values) == 0, none).otherwise(let(values, lambda v: let(blocks(v), joined)))


def spans(text: Column, regex: str, context: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java regex that never matches the empty string, as
    array<struct<start, end, value>>. Offsets are code points; end is exclusive.

    What lies between the matches (split) and the matches themselves alternate, so their lengths add up to offsets.
    With `context`, a field `pattern` more: its result for the text before a match, back to the end of the match before
    the one before. All such texts together are at most twice the text.
    """
    kind = "array<" + (SPAN if context is None else SPAN.replace(">", ",pattern:string>")) + ">"

    def span(x: Column, i: Column, m: Column, b: Column, ends: Column) -> Column:
        own = [(F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("value")]
        if context is not None:
            own.append(context(F.when(i == 0, F.get(b, i)).otherwise(F.concat(F.get(b, i - 1), F.get(m, i - 1), F.get(b, i)))).alias("pattern"))
        return F.struct(*own)

    def found(m: Column, b: Column) -> Column:
        ends = running(F.zip_with(m, F.slice(b, 1, F.size(m)), lambda x, y: F.length(x) + F.length(y)), lambda x, y: x + y)
        return let(ends, lambda e: F.transform(m, lambda x, i: span(x, i, m, b, e)))

    matches, between = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    every = let(F.struct(matches.alias("m"), between.alias("b")), lambda x: found(x["m"], x["b"]))
    return F.when(text.rlike(regex), every).otherwise(F.array().cast(kind)).cast(kind)


def tagged(found: Column, kind: str, order: int) -> Column:
    """Spans as array<struct<start, order, kind, end>>, ready to be merged with other kinds and sorted."""
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def spelled(found: Column) -> Column:
    """Tagged spans as kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
