"""Sources: CSV, Parquet and JSON by any path that Spark reads, with existence and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed columns that a table must have.
REQUIRED = {
    "interactions": ("user_id", "product_id", "rating", "cmt_date"),
    "products": ("product_id", "product_name"),
    "attributes": ("product_id",),
    "processed": ("user_id", "product_id", "u_idx", "i_idx", "rating", "confidence_score", "is_positive", "split"),
}


def hadoop_path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = hadoop_path(spark, path)
    return bool(fs.exists(where))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that is there; FileNotFoundError if none is."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(f"none of {paths}")


def missing_columns(df: DataFrame, table: str) -> list[str]:
    return [c for c in REQUIRED.get(table, ()) if c not in df.columns]


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """df, or ValueError that names what a table of that kind lacks. Needs no job."""
    if lacking := missing_columns(df, table):
        raise ValueError(f"{table}: missing columns {lacking}")
    return df


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A quoted, possibly multi-line CSV with a header. Without a schema all columns are text."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_csvs(spark: SparkSession, folder: str, files: dict[str, str]) -> dict[str, DataFrame]:
    """Tables by name; every file must be there before any is read, and have its table's columns."""
    lacking = [f for f in files.values() if not exists(spark, f"{folder}/{f}")]
    if lacking:
        raise FileNotFoundError(f"{folder}: {lacking}")
    return {name: require_columns(read_csv(spark, f"{folder}/{f}"), name) for name, f in files.items()}


def read_csv_any_encoding(spark: SparkSession, path: str, column: str, encodings=("UTF-8", "ISO-8859-1")) -> DataFrame:
    """The first encoding under which no value of the column has a replacement character."""
    for encoding in encodings:
        df = read_csv(spark, path, encoding=encoding)
        if df.where(F.contains(F.col(column), F.lit("�"))).isEmpty():
            return df
    return df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and a filter that reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_json_maps(spark: SparkSession, glob: str) -> DataFrame:
    """(key, value) of JSON objects in files of a glob."""
    lines = spark.read.text(glob, wholetext=True)
    return lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A JDBC table; the driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
