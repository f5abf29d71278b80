"""Coercion, validation, dedup, labels and data-quality reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import once

#: Fixed date formats, in the order in which they are tried.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "yyyy-MM-dd", "dd-MM-yyyy")


def to_long(c: Column) -> Column:
    """A whole number from text or numbers ('3.0' is 3); null where there is none."""
    whole = c.cast("string").rlike(r"^\s*[+-]?\d{1,19}\s*$")  # a cast that fails costs far more than this
    return F.when(whole, c.try_cast("bigint")).otherwise(c.try_cast("double").try_cast("bigint"))


def to_double(c: Column) -> Column:
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def coerce(df: DataFrame, longs: list[str] = (), doubles: list[str] = ()) -> DataFrame:
    """Columns made numbers; rows where one can't be are dropped."""
    out = df.withColumns({c: to_long(F.col(c)) for c in longs} | {c: to_double(F.col(c)) for c in doubles})
    return out.dropna(subset=[*longs, *doubles])


def coercion_losses(df: DataFrame, longs: list[str] = (), doubles: list[str] = ()) -> DataFrame:
    """(column, missing, unparsable): counted before anything is dropped."""
    parsed = {c: to_long(F.col(c)) for c in longs} | {c: to_double(F.col(c)) for c in doubles}
    row = df.agg(*[F.array(F.lit(c), F.count_if(F.col(c).isNull()).cast("string"), F.count_if(F.col(c).isNotNull() & p.isNull()).cast("string")).alias(c) for c, p in parsed.items()])
    each = row.select(F.explode(F.array(*[F.col(c) for c in parsed])).alias("x"))
    return each.select(F.col("x")[0].alias("column"), F.col("x")[1].cast("bigint").alias("missing"), F.col("x")[2].cast("bigint").alias("unparsable"))


def _shape(fmt: str) -> str:
    """A regex for texts of a format's shape: digits where it has fields."""
    return "^" + re.sub("[A-Za-z]+", lambda m: rf"\d{{{len(m.group())}}}", re.escape(fmt).replace(r"\ ", " ")) + "$"


def _built(c: Column, fmt: str) -> Column:
    """The timestamp that the fields at the format's places name; null if there is none such."""
    field = lambda name: F.substring(c, fmt.index(name) + 1, len(name)).try_cast("int") if name in fmt else F.lit(0)
    return F.try_make_timestamp(*[field(x) for x in ("yyyy", "MM", "dd", "HH", "mm", "ss")])


def _parsed(c: Column, formats: list[str]) -> Column:
    """A timestamp where the text has the shape of one of the formats (its digits and marks) and is a date; of formats of
    one shape the first that gives a date."""
    same: dict[str, list[str]] = {}
    for f in formats:
        same.setdefault(_shape(f), []).append(f)
    out = None
    for of, held in same.items():
        value = F.coalesce(*[_built(c, f) for f in held])
        out = F.when(c.rlike(of), value) if out is None else out.when(c.rlike(of), value)
    return out


def parse_dates(df: DataFrame, column: str, mode: str = "coalesce", formats=DATE_FORMATS) -> DataFrame:
    """Text to timestamps. mode 'coalesce': the first format that fits a row; 'column': one format for all rows, the
    first that parses any (other rows become null)."""
    if mode == "coalesce":
        # once: filters on the result repeat the expression, and with it whatever the text is computed from.
        return df.withColumn(column, once(F.col(column), lambda c: _parsed(c, list(formats))))
    tried = [_parsed(F.col(column), [f]) for f in formats]
    found = df.agg(*[F.count(t).alias(f"f{i}") for i, t in enumerate(tried)]).first()
    best = next((i for i in range(len(formats)) if found[i]), 0)
    return df.withColumn(column, tried[best])


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(column).between(low, high))


def validate(df: DataFrame, user="user_id", item="product_id", rating="rating", date="ts") -> DataFrame:
    """Coerce, parse, drop incomplete rows and ratings outside 1 to 5.

    The parsed columns come out of an array of one struct, which filters aren't pushed through: each text is parsed once,
    and not again by the filters.
    """
    parsed = {user: to_long(F.col(user)), item: to_long(F.col(item)), rating: to_double(F.col(rating)), date: once(F.col(date), lambda c: _parsed(c, list(DATE_FORMATS)))}
    rest = [c for c in df.columns if c not in parsed]
    out = df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in parsed.items()])))).select(*df.columns)
    return in_range(out.dropna(subset=list(parsed)), rating, 1, 5)


def dedup_latest(df: DataFrame, keys: list[str], date: str, rating: str, tie: str) -> DataFrame:
    """One row for each key: the latest, then the highest rated, then the smallest tie-break."""
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc_nulls_last(), F.col(rating).desc_nulls_last(), F.col(tie).asc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def duplicate_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """(duplicate_rows, duplicate_groups) for key groups of more than one row."""
    n = df.groupBy(*keys).count().where("count > 1")
    return n.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"), F.count("*").alias("duplicate_groups"))


def label_flags(df: DataFrame, rating: str = "rating", positive: float = 4, negative: float = 3) -> DataFrame:
    return df.withColumns({"is_positive": (F.col(rating) >= positive).cast("int"), "is_hard_negative": (F.col(rating) <= negative).cast("int")})


def label_violations(df: DataFrame, rating: str = "rating") -> DataFrame:
    both = (F.col("is_positive") == 1) & (F.col("is_hard_negative") == 1)
    return df.agg(F.count_if(both).alias("both"), F.count_if((F.col("is_positive") == 1) != (F.col(rating) >= 4)).alias("wrong_positive"))


def missing_report(df: DataFrame) -> DataFrame:
    """(column, missing) of every column."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "missing")


def outlier_report(df: DataFrame, key: str, rating: str = "rating", most: int = 500, least: int = 3, bias: float = 0.9) -> DataFrame:
    """One row: keys with more than `most` and under `least` rows, counts' mean, median, maximum and minimum, and
    whether one rating has more than `bias` of all rows."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    sizes = n.agg(
        F.count_if(F.col("n") > most).alias("heavy"), F.count_if(F.col("n") < least).alias("cold"), F.round(F.avg("n"), 6).alias("mean"),
        F.percentile("n", F.lit(0.5)).alias("median"), F.max("n").alias("most"), F.min("n").alias("least"),
    )
    shares = df.groupBy(rating).count().withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy()))
    return sizes.crossJoin(shares.agg((F.max("share") > bias).cast("int").alias("biased")))


def text_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, changed): null-safe differences of two tables that share a key."""
    both = a.alias("a").join(b.alias("b"), key)
    row = both.agg(*[F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "changed")
