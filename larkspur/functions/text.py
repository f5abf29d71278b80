"""Text expressions: normalising, tagging, sentiment, review quality, search spans."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the review-quality adjustment.
LENGTH_MIN_WORDS, LENGTH_BASE, LENGTH_STEP, LENGTH_CAP = 25, 0.02, 0.002, 0.06
SHORT_WORDS, SHORT_PENALTY = 4, 0.08
POSITIVE_STEP, POSITIVE_CAP, NEGATIVE_STEP, NEGATIVE_CAP = 0.015, 0.05, 0.02, 0.08
MISMATCH, MISMATCH_SOFT = 0.88, 0.928
UNIQUE_RATIO, UNIQUE_FACTOR = 0.35, 0.88
RECENCY_FLOOR, RECENCY_WEIGHT, RECENCY_DAYS = 0.65, 0.35, 365.0


def normalize_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalize_query(c: Column, abbreviations: dict[str, str]) -> Column:
    """Lower case, abbreviations expanded once (longest first), marks dropped, spaces collapsed.

    Each abbreviation first becomes a private character, so that no expansion is expanded again.
    """
    out = F.lower(F.trim(c))
    order = sorted(abbreviations, key=lambda a: (-len(a), a))
    for i, short in enumerate(order):
        out = F.regexp_replace(out, rf"(?U)\b\Q{short}\E\b", chr(0xE000 + i))
    out = F.regexp_replace(out, "(?U)[^\\w\\s-]", "")
    for i, short in enumerate(order):
        out = F.replace(out, F.lit(chr(0xE000 + i)), F.lit(abbreviations[short]))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def tags(c: Column, words: dict[str, list[str]], default: str) -> Column:
    """Sorted names whose words occur in the text, comma-joined; `default` if there are none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    found = F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ws]), F.lit(n)) for n, ws in sorted(words.items())]))
    return F.when(F.size(found) == 0, default).otherwise(F.array_join(found, ","))


def labelled_text(parts: dict[str, Column], default: str = "unknown") -> Column:
    """'label: value' parts joined by ' [SEP] '; blank values become the default."""
    one = [F.concat(F.lit(f"{n}: "), F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))) for n, c in parts.items()]
    return F.concat_ws(" [SEP] ", *one)


def keyword_count(c: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))


def keyword_sentiment(c: Column, words: list[str]) -> Column:
    """0.3, 0.5, 0.7 for 0, 1, 2 of the words, then 0.8 and 0.05 for each more than three, up to 1."""
    n = keyword_count(c, words)
    return F.when(n == 0, 0.3).when(n == 1, 0.5).when(n == 2, 0.7).otherwise(F.least(0.8 + 0.05 * (n - 3), F.lit(1.0)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def unique_ratio(c: Column) -> Column:
    """Distinct characters over characters, without white space; 1 for none."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s", "")
    n = F.length(bare)
    return F.when(n > 0, F.size(F.array_distinct(F.split(bare, ""))) / n).otherwise(1.0)


def recency(ts: Column, as_of: Column) -> Column:
    """0.65 + 0.35 exp(-age / 365): 365 days is the e-folding time."""
    age = F.greatest(F.datediff(as_of, ts), F.lit(0))
    return RECENCY_FLOOR + RECENCY_WEIGHT * F.exp(-age / RECENCY_DAYS)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def adjusted_quality(base: Column, text: Column, rating: Column, ts: Column, as_of: Column, positive: list[str], negative: list[str]) -> Column:
    """struct<quality, suspicious>: a base score with the length bonus, the short-and-high penalty, keyword terms, rating
    mismatch, recency and unique-character ratio applied in this order, then clipped to 0..1."""
    seen = F.struct(word_count(text).alias("words"), keyword_count(text, positive).alias("pos"), keyword_count(text, negative).alias("neg"), unique_ratio(text).alias("unique"))

    def adjusted(f: Column) -> Column:
        words, pos, neg = f["words"], f["pos"], f["neg"]
        bonus = F.when(words >= LENGTH_MIN_WORDS, F.least(LENGTH_BASE + LENGTH_STEP * (words - LENGTH_MIN_WORDS), F.lit(LENGTH_CAP))).otherwise(0.0)
        short = (words <= SHORT_WORDS) & (rating >= 4)
        q = base + bonus - F.when(short, SHORT_PENALTY).otherwise(0.0)
        q = q + F.least(POSITIVE_STEP * pos, F.lit(POSITIVE_CAP)) - F.least(NEGATIVE_STEP * neg, F.lit(NEGATIVE_CAP))
        hard, soft = (rating >= 4) & (neg > pos), (rating <= 2) & (pos > neg)
        q = q * F.when(hard, MISMATCH).when(soft, MISMATCH_SOFT).otherwise(1.0) * recency(ts, as_of)
        few = f["unique"] < UNIQUE_RATIO
        q = q * F.when(few, UNIQUE_FACTOR).otherwise(1.0)
        return F.struct(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)).alias("quality"), (short | hard | soft | few).cast("int").alias("suspicious"))

    return once(seen, adjusted)


def search_pattern(pattern: str, mode: str = "literal", case: bool = False) -> str:
    """A regex that finds a literal, a whole word or a regex, with or without regard to case."""
    regex = {"literal": rf"\Q{pattern}\E", "word": rf"\b\Q{pattern}\E\b", "regex": pattern}[mode]
    return ("(?U)" if case else "(?iU)") + regex


def grep(c: Column, pattern: str, mode: str = "literal", case: bool = False) -> Column:
    """Number of matches of a literal, a whole word or a regex."""
    return F.regexp_count(c, F.lit(search_pattern(pattern, mode, case)))


def sums_before(values: Column, block: int = 256) -> Column:
    """For each of an array of numbers the sum of those before it. Blocks are summed first, so the time grows with the
    size times the block's, and with the square of the number of blocks only."""
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)

    def within(blocks: Column) -> Column:
        own = lambda b, start: F.transform(b, lambda _, j: start + total(F.slice(b, 1, j)))
        return once(F.transform(blocks, total), lambda totals: F.flatten(F.transform(blocks, lambda b, k: once(total(F.slice(totals, 1, k)), lambda start: own(b, start)))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda k: F.slice(values, k * block + 1, block))
    return F.when(F.size(values) > 0, once(cut, within)).otherwise(F.array().cast("array<bigint>"))


def match_spans(c: Column, pattern: str, mode: str = "literal", case: bool = False) -> Column:
    """array<struct<start, end, match>> of all leftmost non-overlapping matches: places in code points, end exclusive.
    Null for a null text. A pattern must not match the empty string.

    The matches and what lies between them (a split by the pattern) alternate, so running sums of their lengths are places.
    """
    regex = search_pattern(pattern, mode, case)

    def placed(found: Column) -> Column:
        each = F.zip_with(found["m"], F.slice(found["b"], 1, F.size(found["m"])), lambda m, b: (F.length(m) + F.length(b)).cast("long"))
        span = lambda m, at, i: F.struct((at + F.length(found["b"][i])).cast("int").alias("start"), (at + F.length(found["b"][i]) + F.length(m)).cast("int").alias("end"), m.alias("match"))
        return once(sums_before(each), lambda at: F.transform(found["m"], lambda m, i: span(m, at[i], i)))

    parts = F.struct(F.regexp_extract_all(c, F.lit(regex), F.lit(0)).alias("m"), F.split(c, regex, -1).alias("b"))
    return F.when(c.isNotNull(), F.when(c.rlike(regex), once(parts, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>")))


def matches(df: DataFrame, text: str, pattern: str, mode: str = "literal", case: bool = False) -> DataFrame:
    """The table of matches: df without the text, a row for each match with its number k (from 1), start, end and match."""
    rest = [c for c in df.columns if c != text]
    each = df.select(*rest, F.posexplode(match_spans(F.col(text), pattern, mode, case)).alias("k", "span"))
    return each.select(*rest, (F.col("k") + 1).alias("k"), "span.*")


def highlight(c: Column, pattern: str, mode: str = "literal", case: bool = False, left: str = "[", right: str = "]") -> Column:
    """The text with marks around each match."""
    quoted = lambda x: x.replace("\\", r"\\").replace("$", r"\$")
    return F.regexp_replace(c, search_pattern(pattern, mode, case), f"{quoted(left)}$0{quoted(right)}")


def preview(c: Column, n: int = 80) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def version_parts(c: Column) -> Column:
    """struct<model, major, minor> of ids like als_v2.3."""
    return F.struct(
        F.regexp_extract(c, r"^(.*)_v\d+\.\d+$", 1).alias("model"), F.regexp_extract(c, r"_v(\d+)\.\d+$", 1).try_cast("int").alias("major"), F.regexp_extract(c, r"_v\d+\.(\d+)$", 1).try_cast("int").alias("minor")
    )


def token_adjustment(c: Column, positive: list[str], negative: list[str], up: float = 0.03, up_cap: float = 0.10, down: float = 0.05, down_cap: float = 0.15) -> Column:
    """Adjustment by words joined with underscores (names of pictographs): each good one adds, each bad one takes away,
    up to a cap. A skin tone at the end of a name doesn't count."""
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w+(?:_\w+)+\b"), F.lit(0)), lambda t: F.regexp_replace(t, "_(light|medium_light|medium|medium_dark|dark)_skin_tone$", ""))
    count = lambda names: F.size(F.filter(found, lambda t: t.isin(*names)))
    return F.least(up * count(positive), F.lit(up_cap)) - F.least(down * count(negative), F.lit(down_cap))


def score_texts(df: DataFrame, text: str, model, name: str = "score") -> DataFrame:
    """df with a score by a plain function from a list of texts to numbers, called with whole Arrow batches."""
    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in model(batch.fillna("").tolist())])

    return df.withColumn(name, run(text))


def word_model(weights: dict[str, float], per_word: float = 0.0) -> Callable[[list[str]], list[float]]:
    """A logistic model of word counts for score_texts(): weights of lower-case words, and one for every word."""

    def score(texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            total = per_word * len(re.findall("[^ ]+", t)) + sum(weights.get(w, 0.0) for w in re.findall(r"\b[a-z]+\b", t.lower()))
            out.append(1 / (1 + math.exp(-total)) if total > -700 else 0.0)
        return out

    return score


def hashed_vector(df: DataFrame, text: str, size: int = 256, name: str = "vec") -> DataFrame:
    """df with unit vectors of hashed words: an encoder that needs no model."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = df.withColumn("_w", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != ""))
    out = Normalizer(inputCol="_tf", outputCol="_n").transform(HashingTF(numFeatures=size, inputCol="_w", outputCol="_tf").transform(words))
    return out.withColumn(name, vector_to_array("_n")).drop("_w", "_tf", "_n")
