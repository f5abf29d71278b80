"""Positions in an order within groups of any size, and a CRC-32 for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, small


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Join condition on all keys, where null meets null."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def positions(rows: DataFrame, group: list[str], order: list[Column], name: str = "ranked") -> DataFrame:
    """rows with `pos` (long, from 0) in its group's order and `n` (long), the group's rows. rows must be written
    (materialize), as they are read twice.

    Rows are dealt to ranges of (group, order) and sorted there, so a group of a third of all rows is spread over many
    tasks; rows alike in all of it are told apart by where they are written. A row's position is its place in its range
    less where its group starts there, and the group's rows in the ranges before: one row a range and group.
    """
    keys = [F.col(g).asc() for g in group] + order
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    parts = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    mine = Window.partitionBy(*group)
    before = mine.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "n": F.sum("_rows").over(mine)})
    parts = small(materialize(parts, "ranges"))
    out = placed.join(parts, same_keys(placed, parts, [*group, "_range"]))
    pos = (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos")
    return out.select(*[placed[c] for c in rows.columns], pos, "n")


#: DuckDB: one row with the table of CRC-32's polynomial, and the CRC-32 of an ASCII string as an expression over it.
CRC_TABLE_SQL = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS crc"""


def crc_sql(value: str) -> str:
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({value}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"""
