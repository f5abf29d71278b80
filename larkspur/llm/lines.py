"""Line dedup by site-relative frequency.

Pages are grouped by host. A line's frequency on a host is the number of the host's pages that contain it over the
number of its pages; lines above the boilerplate ratio are dropped from that host's pages. DataFrame expressions only.

A host's boilerplate list is bounded by arithmetic: with an average of L distinct lines a page, at most L / ratio lines
can be on more than that share of the pages. So the list travels as one array a host, and pages are never exploded for
the removal itself. Counting is a partial aggregate over (host, line digest), so a host with a third of all pages is
spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import let, materialize

#: A line is boilerplate on a host if it is on more than this share of its pages, and on at least this many.
RATIO, MIN_PAGES = 0.01, 5


def _digest(line: Column) -> Column:
    return F.unhex(F.sha2(line, 256))


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(host, lines): for each host with boilerplate, the SHA-256 digests of those lines in hex. A null host is a host of its own.
    Without `copies`, a host's pages of the same text are one page."""
    pages = docs.select(F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("page", F.xxhash64("text"))
    number = F.count("*") if copies else F.count_distinct("page")
    lines = F.array_distinct(F.filter(F.split("text", "\n", -1), lambda x: ~_blank(x)))
    counts = pages.select("host", "page", F.explode(lines).alias("line")).groupBy("host", _digest(F.col("line")).alias("digest")).agg(number.alias("n"))
    often = materialize(counts.where(F.col("n") >= min_pages), "lines")
    totals = pages.groupBy("host").agg(number.alias("pages"))
    held = often.join(totals, often["host"].eqNullSafe(totals["host"])).where(F.col("n") > ratio * F.col("pages"))
    return held.groupBy(often["host"]).agg(F.collect_list(F.lower(F.hex("digest"))).alias("lines"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """docs with boilerplate lines taken out of the text, and `n_dropped` (int) lines dropped.

    Lines end at newlines. Blank lines stay, and count for nothing. A page that repeats a line counts once for it,
    and loses every repeat. A column n_dropped of docs is replaced. A null text stays null; a page of boilerplate only becomes empty but stays. Repeated
    rows are pages of their own, unless `copies` is false: then a large group of copies doesn't make its lines
    boilerplate. All other columns pass through; an empty table gives no rows.
    """
    found = materialize(boilerplate(docs, host_col, text_col, ratio, min_pages, copies), "boilerplate")
    # The row travels whole, so its other columns may have any name.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host_col).alias("site"), F.col(text_col).alias("text"))
    rows = rows.join(found, rows["site"].eqNullSafe(found["host"]), "left")
    every = F.split("text", "\n", -1)
    # A page's own boilerplate is found by hash in one pass over the host's list, not by a search of it for each line.
    def without(digests: Column) -> Column:
        here = lambda bad: F.filter(every, lambda x, i: _blank(x) | ~F.array_contains(bad, F.get(digests, i)))
        return let(F.array_intersect(digests, "lines"), lambda bad: F.when(F.size(bad) == 0, every).otherwise(here(bad)))

    kept = let(F.transform(every, lambda x: F.sha2(x, 256)), without)
    cleaned = rows.withColumn("kept", F.when(F.col("lines").isNotNull() & F.col("text").isNotNull(), kept))
    text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size(every) - F.size("kept"))
    columns = [text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c != "n_dropped"]
    return cleaned.select(*columns, dropped.alias("n_dropped"))


#: The same rows in DuckDB SQL, over a table or query {docs}.
SQL = f"""
WITH lines AS (
  SELECT DISTINCT d.doc_id, d.source, u.line FROM {{docs}} d, unnest(string_split(d.text, chr(10))) AS u(line) WHERE trim(u.line) <> ''
), totals AS (SELECT source, count(*) AS pages FROM {{docs}} GROUP BY source),
found AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(*) AS n FROM lines GROUP BY source, line) l JOIN totals t USING (source)
  WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages
), held AS (SELECT source, list(line) AS bad FROM found GROUP BY source)
"""
