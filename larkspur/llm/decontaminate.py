"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window is `width` consecutive words of a benchmark item (a shorter item is one window). A document word is hit if
it lies in any occurrence of any window. Windows are sets of word shingles, ordered by rarity in the corpus; as all
of a window's shingles must occur, the necessary prefix is its rarest one. Documents join on that shingle only; the
shingle's place in the window bounds where the window can start and end, and the words there are then compared.

The corpus is read once: a Bloom filter over the benchmark's shingles picks the stretches of text whose every word lies
in some benchmark shingle. Equal stretches are joined once, however many documents hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import keyed, materialize, same_row, small

#: The Bloom filter's size: 64 bits a shingle, between 2**20 and 2**28 (32 MB); what it lets through is joined exactly, so
#: with over 16 million shingles more of the text is joined, and nothing is lost.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 20, 28
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: bytes) -> list[bytes]:
    """The lower-cased words of UTF-8 text."""
    return text.translate(_TO_WORDS).split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    s = h[:n].copy()
    for j in range(1, k):
        s = s * _M1 + h[j : j + n]
    return (s ^ (s >> np.uint64(29))) * _M2


def _bloom_bits(s: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - size)
    return s >> top, (s * _M1) >> top


def _bloom_filter(shingles: DataFrame) -> np.ndarray:
    """The filter's bits, packed in bytes: 2**20 to 2**28 of them, the number being a power of two."""
    size = min(max((BITS_EACH * shingles.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = [_shingle_hashes(_hashes(w), len(w)) for x in b.column("shingle").to_pylist() if (w := x.encode().split(b" "))]
            at = np.concatenate([y for x in s for y in _bloom_bits(x, size)]) if s else np.empty(0, np.uint64)
            bits = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits)], ["slot", "bits"])

    rows = shingles.mapInArrow(batches, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _passes(s: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Which shingles pass the filter."""
    out = np.ones(len(s), bool)
    for at in _bloom_bits(s, (len(bloom) * 8).bit_length() - 1):
        out &= (bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _stretches(texts: list[bytes], sizes: list[int], bloom: np.ndarray) -> list[tuple[int, list[str]]]:
    """For each text its number of words and the maximal stretches covered by shingles that pass the filter."""
    each = [words_of(t) for t in texts]
    words = [w for x in each for w in x]
    ends = np.cumsum([len(x) for x in each])
    doc = np.repeat(np.arange(len(each)), [len(x) for x in each])
    h = _hashes(words)
    covered = np.zeros(len(words) + 1, np.int64)
    for k in sizes:
        if len(words) >= k:
            at = np.flatnonzero(_passes(_shingle_hashes(h, k), bloom) & (doc[: len(words) - k + 1] == doc[k - 1 :]))
            np.add.at(covered, at, 1)
            np.add.at(covered, at + k, -1)
    mask = np.cumsum(covered)[:-1] > 0
    out: list[tuple[int, list[str]]] = [(len(x), []) for x in each]
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    cuts = np.union1d(edge, ends[ends < len(words)]) if len(words) else edge
    bounds = [0, *cuts.tolist(), len(words)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a and mask[a]:
            out[doc[a]][1].append(b" ".join(words[a:b]).decode("utf-8", "replace"))
    return out


def _scan(docs: DataFrame, sizes: list[int], bloom: np.ndarray) -> DataFrame:
    """(doc_id, text_key, n_words, stretches) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in it:
            texts = [x.as_buffer().to_pybytes() for x in b.column("text").cast(pa.binary())]
            found, start, size = [], 0, 0
            for i, t in enumerate(texts):  # about 1 MB of text at a time
                size += len(t)
                if size > 1_000_000 or i + 1 == len(texts):
                    found += _stretches(texts[start : i + 1], sizes, bits)
                    start, size = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.string()))],
                ["doc_id", "text_key", "n_words", "stretches"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(batches, f"doc_id {kind}, text_key long, n_words long, stretches array<string>")


def _windows(benchmark: DataFrame, item_col: str, text_col: str, width: int) -> DataFrame:
    """(item_id, window, w): each item's distinct windows as space-joined words."""
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.col(item_col).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    items = items.withColumn("w", F.least(F.lit(width), F.size("words")))
    at = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("w"))))
    return at.select("item_id", F.array_join(F.slice("words", F.col("at") + 1, F.col("w")), " ").alias("window"), "w").distinct()


def _shingled(df: DataFrame, words: str, k: str) -> DataFrame:
    """A row for each k-word shingle of the array `words`, at `pos`; arrays shorter than k give none."""
    there = df.where(F.size(words) >= F.col(k)).withColumn("pos", F.explode(F.sequence(F.lit(0), F.size(words) - F.col(k))))
    return there.withColumn("shingle", F.array_join(F.slice(words, F.col("pos") + 1, F.col(k)), " "))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, shingle_words: int = 5) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, items) for every row of docs; items is the sorted array of item ids (as
    strings) with a window in the document, null where there is none.

    Null and empty texts have no words and no hits. Items without words have no windows. Repeated rows each keep
    their row; rows that share a doc_id are told apart by their text. Items with a null id hit words but are not
    listed. Empty tables give no rows or no hits. Other columns are not read.
    """
    docs = keyed(docs, id_col, text_col)
    of_items = materialize(_windows(benchmark, item_col, item_text_col, width), "windows")
    windows = of_items.select("window", "w").distinct().withColumns({"k": F.least(F.lit(shingle_words), F.col("w")), "words": F.split("window", " ")})
    pieces = materialize(_shingled(windows, "words", "k").select("window", "w", "k", "pos", "shingle"), "shingles")
    sizes = sorted(r[0] for r in pieces.select("k").distinct().collect())  # at most shingle_words values

    distinct = materialize(pieces.select("shingle").distinct(), "distinct")
    scanned = materialize(_scan(docs, sizes, _bloom_filter(distinct)), "stretches")
    # Rows alike in id and text count once; their result goes to each of them.
    hits = scanned.where(F.size("stretches") > 0).groupBy("doc_id", "text_key").agg(F.first("stretches").alias("stretches"))
    hits = materialize(hits.select("doc_id", "text_key", F.explode("stretches").alias("stretch")).withColumn("run", F.sha2("stretch", 256)), "hits")
    runs = hits.groupBy("run").agg(F.first("stretch").alias("stretch"), F.count("*").alias("n")).withColumn("words", F.split("stretch", " "))
    by_size = F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"))
    in_runs = _shingled(runs.withColumn("k", by_size), "words", "k")
    # Around a shingle only the words that a window through it can reach are carried along.
    reach = F.greatest(F.col("pos") - width, F.lit(0))
    in_runs = materialize(in_runs.select("run", "n", "k", "pos", "shingle", F.size("words").alias("size"), reach.alias("from"), F.slice("words", reach + 1, 2 * width + shingle_words).alias("near")), "runs")

    rarity = in_runs.groupBy("shingle").agg(F.sum("n").alias("df"))
    ranked = pieces.join(rarity, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = ranked.groupBy("window", "w", "k").agg(F.min(F.struct("df", "shingle", "pos")).alias("rarest")).where("rarest.df > 0")
    prefix = prefix.select("window", "w", F.col("k").alias("pk"), F.col("rarest.shingle").alias("shingle"), F.col("rarest.pos").alias("offset"))

    start = F.col("pos") - F.col("offset")
    fits = (F.col("k") == F.col("pk")) & (start >= 0) & (start + F.col("w") <= F.col("size"))
    same = F.array_join(F.slice("near", start - F.col("from") + 1, F.col("w")), " ") == F.col("window")
    found = in_runs.join(prefix, "shingle").where(fits).where(same)
    found = materialize(found.select("run", start.alias("start"), "w", "window"), "found")

    hit_words = found.select("run", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("w") - 1)).alias("at")).distinct().groupBy("run").agg(F.count("*").alias("n_hit"))
    run_items = found.select("run", "window").distinct().join(of_items, "window").where("item_id is not null").select("run", F.col("item_id").cast("string").alias("item")).distinct()
    keys = ["doc_id", "text_key"]
    per_doc = hits.join(hit_words, "run").groupBy(*keys).agg(F.sum("n_hit").alias("n_hit"))
    items = hits.select(*keys, "run").join(run_items, "run").select(*keys, "item").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = scanned.select(*keys, "n_words")
    out = out.join(per_doc, same_row(out, per_doc), "left").select(out["doc_id"], out["text_key"], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"))
    return out.join(items, same_row(out, items), "left").select(out["doc_id"], out["text_key"], "n_words", "n_hit", "items")


def is_contaminated():
    """The rule: some word is hit, and at least a twentieth of all words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that the rule calls contaminated; columns as they were.

    The rows to drop are written first, so that their number is known: texts are only shuffled if very many go.
    """
    bad = contamination(docs, benchmark).where(is_contaminated()).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    bad = materialize(bad, "contaminated")
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(small(bad), docs["doc_id"].eqNullSafe(bad["_id"]) & (own == bad["_key"]), "left_anti")


#: The contract's rows in DuckDB SQL: every window of every document against every window of every item.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT d.doc_id, s.k, i, array_to_string(w[i:i + s.k - 1], ' ') AS t FROM d, sizes s, unnest(range(1, len(w) - s.k + 2)) AS r(i) WHERE len(w) >= s.k),
hits AS (SELECT DISTINCT a.doc_id, a.i, a.k, x.item_id FROM grams a JOIN windows x ON x.k = a.k AND x.t = a.t),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, k)) AS r(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
