"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed byte 2- and 3-grams. Each language has several centroids, clustered
from a bounded sample of labelled documents by spherical k-means. A text gets the language of the centroid with the
largest cosine; if its distance to that centroid is beyond the language's limit, it is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialize

#: Hashed dimensions; labelled documents sampled for each language; centroids for each language.
DIMENSIONS, SAMPLE, CLUSTERS = 8192, 500, 4
UNKNOWN = "und"
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_HASH = np.uint32(2654435761)
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)


def _counts(text: str) -> np.ndarray:
    """Counts of hashed 2- and 3-grams of the lower-cased letters, words set apart by single spaces."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] | b[1:] << np.uint32(8)
    three = two[:-1] | b[2:] << np.uint32(16)
    grams = np.concatenate([two | np.uint32(1 << 31), three])
    return np.bincount((grams * _HASH) >> _SHIFT, minlength=DIMENSIONS)


def _vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.stack([_counts(t) for t in texts]).astype(np.float32)
    x = np.sqrt(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def _clusters(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Unit centroids of unit rows; starts from the rows farthest from those chosen before."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        nearest = (x @ x[chosen].T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        chosen.append(int(np.argmin(nearest)))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


@dataclass(frozen=True)
class Model:
    """Centroids (rows of unit vectors), the language of each, each language's distance limit, and the IDF weights."""

    langs: list[str]
    centroids: np.ndarray
    limits: dict[str, float]
    idf: np.ndarray


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS, slack: float = 0.5) -> Model:
    """Learn from rows with a language and a text with letters: at most `sample` of each language, chosen by a hash.

    A language's distance limit is its largest distance in the sample, plus `slack` of what is left up to 1. Without
    labelled rows the model has no languages. The driver gets the IDF (one number a dimension) and the centroids.
    """
    rows = labelled.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # Written first: its size is then known, so Spark sends it to the texts where it is small.
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    # The share that gives twice the sample on average, then exactly the first by hash.
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n"))
    some = rows.join(sizes, "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    some = materialize(some.withColumn("k", first).where(F.col("k") <= sample).select("lang", "text", "h"), "sample")

    def seen(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            df = sum((_counts(t) > 0).astype(np.int64) for t in p["text"])
            yield pd.DataFrame({"g": np.arange(DIMENSIONS), "df": df, "n": len(p)}) if len(p) else pd.DataFrame({"g": [], "df": [], "n": []})

    held = some.select("text").mapInPandas(seen, "g long, df long, n long").groupBy("g").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).collect()
    idf = np.zeros(DIMENSIONS, np.float32)
    for g, df, n in held:
        idf[g] = np.log((1 + n) / (1 + df)) + 1

    def centroids(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["h", "text"])
        x = _vectors(p["text"].tolist(), idf)
        c = _clusters(x, clusters)
        far = float(1 - (x @ c.T).max(axis=1).min())
        return pd.DataFrame({"lang": p["lang"].iloc[0], "k": np.arange(len(c)), "centroid": list(c), "far": far})

    found = some.groupBy("lang").applyInPandas(centroids, "lang string, k int, centroid array<float>, far double").orderBy("lang", "k").collect()
    limits = {r["lang"]: r["far"] + slack * (1 - r["far"]) for r in found}
    return Model([r["lang"] for r in found], np.array([r["centroid"] for r in found], np.float32).reshape(len(found), DIMENSIONS), limits, idf)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the cosine, 0 to 1) and rejected (beyond the language's distance limit, or unknown).

    Only the text decides. A null text, or one without a letter, is `und` with score 0 and rejected; so is all text
    if the model has no languages. Rows pass in order with all their columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            texts = b.column(text_col).to_pylist()
            lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            known = [i for i, t in enumerate(texts) if _has_letter(t)] if m.langs else []
            for at in range(0, len(known), 64):
                part = known[at : at + 64]
                near = _vectors([texts[i] for i in part], m.idf) @ m.centroids.T
                for i, row in zip(part, near, strict=True):
                    best = int(np.argmax(row))
                    lang[i], score[i] = m.langs[best], float(min(max(row[best], 0.0), 1.0))
                    rejected[i] = 1 - score[i] > m.limits[lang[i]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*b.schema.names, "lang_pred", "score", "rejected"])

    docs = docs.drop("lang_pred", "score", "rejected")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(batches, f"{own}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is not held out, and is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable(id_col: str = "doc_id"):
    return F.col(id_col).isNotNull() & ~held_out(id_col)


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the rows whose language is rejected; learns from their own labels outside the held-out fold."""
    model = fit(docs.where(learnable()))
    return predict(docs, model).where(~F.col("rejected")).select(*docs.columns)
