"""Quality classification by an interpolated modified Kneser-Ney model of characters.

Trusted documents are counted into character n-grams up to `order`; Spark sums the counts and joins each n-gram with
its context and its shorter form, level by level, which gives every seen n-gram's probability. A backed-off log
probability then splits into a sum over the n-grams of a text:

    log P(c | h) = u + sum over lengths k of  w[last k characters of hc] + b[last k - 1 characters of h]

with w and b zero for what was not seen. So a document's likelihood is a join of its n-gram counts with the model's
table, summed. The table is cut into shards of bounded size, which travel to the documents: each shard is joined where
the n-grams are made, and only sums by document are shuffled, never n-grams or texts. A document is kept if its perplexity is within the quantile that trusted documents of its language reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, same_row

ORDER = 4
#: Rows of the model in one shard at most (on average); labelled ids that may be broadcast at most.
SHARD_ROWS, BROADCAST_IDS = 500_000, 300_000
_SYMBOL = 16
#: An n-gram's shard is the remainder of its code folded by these shifts; Spark and numpy compute it alike.
_FOLDS, _LOW = (13, 29, 47), (1 << 31) - 1
_DIGIT, _SPACE = ord("0"), ord(" ")


def symbols(text: str) -> np.ndarray:
    """Code points as 16-bit symbols, from 1: digits are one symbol, ASCII white space another, a space comes first."""
    s = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    s[(s >= 48) & (s <= 57)] = _DIGIT
    s[(s >= 9) & (s <= 13)] = _SPACE
    return np.where(s < 0xFFFF, np.maximum(s, 1), 0xFFFF).astype(np.uint64)


def _codes(s: np.ndarray, k: int) -> np.ndarray:
    n = max(len(s) - k + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out << np.uint64(_SYMBOL)) | s[j : j + n]
    return out


def ngram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(k, gram, n): n-grams of length `order`, and shorter ones at the start of a text, with their counts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            held: list[list[np.ndarray]] = [[] for _ in range(order + 1)]
            for t in b.column("text").to_pylist():
                s = symbols(t)
                held[order].append(_codes(s, order))
                for k in range(1, order):
                    held[k].append(_codes(s[:k], k))
            for k in range(1, order + 1):
                gram, n = np.unique(np.concatenate([*held[k], np.empty(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], ["k", "gram", "n"])

    return texts.mapInArrow(batches, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n"))


def _suffix(k: int):
    return F.col("gram").bitwiseAND(F.lit((1 << (_SYMBOL * (k - 1))) - 1))


def _prefix():
    return F.shiftrightunsigned("gram", _SYMBOL)


def _discounts(grams: DataFrame) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n = {r["n"]: r["types"] for r in grams.where("n <= 4").groupBy("n").agg(F.count("*").alias("types")).collect()}
    if not all(n.get(i) for i in (1, 2, 3, 4)):
        return [0.5, 0.75, 1.0]
    y = n[1] / (n[1] + 2 * n[2])
    return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3)]


def train(texts: DataFrame, order: int = ORDER) -> tuple[DataFrame, float]:
    """The model's (gram, w, b) rows and the log probability u of an unseen symbol, from a column `text` without nulls."""
    counts = materialize(ngram_counts(texts, order), "ngrams")
    levels = {order: counts.where(F.col("k") == order).select("gram", "n")}
    for k in range(order - 1, 0, -1):
        # Lower orders count the different symbols before an n-gram; at the start of a text there is none, so it counts itself.
        before = levels[k + 1].select(_suffix(k + 1).alias("gram"), F.lit(1).alias("n"))
        first = counts.where(F.col("k") == k).select("gram", F.lit(1).alias("n"))
        levels[k] = before.unionByName(first).groupBy("gram").agg(F.sum("n").alias("n"))
    out, lower, unseen = None, None, 0.0
    contexts = {}
    for k in range(1, order + 1):
        grams = materialize(levels[k], f"level{k}")
        d = _discounts(grams)
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        per = grams.groupBy(_prefix().alias("h")).agg(F.sum("n").alias("total"), F.sum(discount).alias("mass"))
        contexts[k] = per.select("h", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        if k == 1:
            row = contexts[1].first()
            total, gamma = (float(row["total"]), float(row["gamma"])) if row else (1.0, 1.0)
            base = gamma / (grams.count() + 1)
            unseen = float(np.log(base))
            level = grams.select("gram", F.log((F.col("n") - discount) / total + base).alias("p"), F.lit(unseen).alias("back"))
        else:
            shorter = lower.select(F.col("gram").alias("s"), F.col("p").alias("q"))
            joined = grams.withColumns({"h": _prefix(), "s": _suffix(k)}).join(contexts[k], "h").join(shorter, "s")
            back = F.log("gamma") + F.col("q")
            level = joined.select("gram", F.log((F.col("n") - discount) / F.col("total") + F.exp(back)).alias("p"), back.alias("back"))
        lower = materialize(level, f"p{k}")
        rows = lower.select("gram", (F.col("p") - F.col("back")).alias("w"), F.lit(0.0).alias("b"))
        out = rows if out is None else out.unionByName(rows)
        if k > 1:
            out = out.unionByName(contexts[k].select(F.col("h").alias("gram"), F.lit(0.0).alias("w"), F.log("gamma").alias("b")))
    return out.groupBy("gram").agg(F.sum("w").alias("w"), F.sum("b").alias("b")), unseen


def _shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    for by in _FOLDS:
        gram = gram ^ (gram >> np.uint64(by))
    return (gram & np.uint64(_LOW)) % np.uint64(shards)


def _counted(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the text, gram, n, n_context) for every text's distinct n-grams up to `order`: how often each occurs, and
    how often before another symbol. The n-gram 0 stands for the text: its n is the number of symbols, its n_context 1."""
    each = [symbols(t) for t in texts]
    sizes = np.array([len(s) for s in each])
    yield np.arange(len(each)), np.zeros(len(each), np.uint64), sizes, np.ones(len(each), np.int64)
    for k in range(1, order + 1):
        longs = [i for i, s in enumerate(each) if len(s) >= k]
        found = [np.unique(_codes(each[i], k), return_counts=True) for i in longs]
        if not found:
            continue
        gram, n = (np.concatenate([f[c] for f in found]) for c in (0, 1))
        own = np.array([len(f[0]) for f in found])
        before = n.copy() if k < order else np.zeros_like(n)
        if k < order:  # a text's last n-gram is before nothing
            starts = np.cumsum(own) - own
            before[[a + int(np.searchsorted(f[0], _codes(each[i][-k:], k)[0])) for a, f, i in zip(starts.tolist(), found, longs, strict=True)]] -= 1
        yield np.repeat(longs, own), gram, n, before


def document_ngrams(docs: DataFrame, order: int = ORDER, shards: int = 1, shard: int = 0) -> DataFrame:
    """(doc_id, text_key, gram, n, n_context) for the distinct n-grams of every row that are in the shard."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column("text").to_pylist()
            at = 0
            while at < len(texts):  # about 100 kB at a time
                end, size = at, 0
                while end < len(texts) and size < 100_000:
                    size += len(texts[end])
                    end += 1
                for which, gram, n, before in _counted(texts[at:end], order):
                    if shards > 1:
                        here = _shard_of(gram, shards) == shard
                        which, gram, n, before = which[here], gram[here], n[here], before[here]
                    rows = pa.array(which + at)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("text_key").take(rows), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(before.astype(np.int64))], ["doc_id", "text_key", "gram", "n", "n_context"])
                at = end

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text_key", "text").mapInArrow(batches, f"doc_id {kind}, text_key long, gram long, n long, n_context long")


def score(docs: DataFrame, model: DataFrame, unseen: float, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, text_key, loglik, n_symbols) for every distinct doc_id and text_key of docs (with a column `text`).

    Shards are made by hash and hold about shard_rows n-grams. Each is joined to the documents' n-gram counts by
    broadcast, and its sums are written before the next one is sent, so however large the model is, one shard is held.
    """
    spark = docs.sparkSession
    seen = spark.createDataFrame([(0, unseen, 0.0)], "gram long, w double, b double")  # the n-gram 0: all symbols as unseen ones
    model = materialize(model.unionByName(seen), "model")
    shards = max(1, -(-model.count() // shard_rows))
    folded = F.col("gram")
    for by in _FOLDS:
        folded = folded.bitwiseXOR(F.shiftrightunsigned(folded, by))
    part = folded.bitwiseAND(F.lit(_LOW)) % shards
    keys, whole = ["doc_id", "text_key"], F.col("gram") == 0
    sums = None
    for i in range(shards):
        own = model if shards == 1 else model.where(part == i)
        joined = document_ngrams(docs, order, shards, i).join(F.broadcast(own), "gram")
        found = joined.groupBy(*keys).agg(
            F.sum(F.col("n") * F.col("w") + F.col("n_context") * F.col("b")).alias("loglik"), F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("n_symbols"), F.sum(F.when(whole, F.col("n_context")).otherwise(0)).alias("rows")
        )
        found = materialize(found, "sums")
        sums = found if sums is None else sums.unionByName(found)
    if shards > 1:
        sums = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("loglik", "n_symbols", "rows")])
    # Rows alike in id and text were counted together.
    return sums.select(*keys, (F.col("loglik") / F.col("rows")).alias("loglik"), F.floor(F.col("n_symbols") / F.col("rows")).alias("n_symbols"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, prior: float = 200.0, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, text_key, lang, perplexity, threshold, keep) for every row of docs.

    Trusted: labelled of quality 1 and not toxic. Four fifths of the trusted texts, by hash, train the model; the rest
    set the thresholds, as text that the model has seen looks better than it is. A language's threshold is the
    quantile of its trusted documents' perplexities; a language without any (or a null one) gets the quantile over all. A perplexity counts `prior` further symbols of the language's usual likelihood. Null and empty texts have no
    perplexity and aren't kept. Without trusted documents nothing has a threshold, and all with text is kept.
    Repeated rows each keep their row; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text).alias("text_key"))
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    trusted = materialize(trusted, "trusted")
    ids = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    learn = F.pmod("text_key", F.lit(5)) != 0
    texts = rows.where("text <> ''").where(learn).join(ids, "doc_id", "left_semi").select("text")
    model, unseen = train(texts, order)
    sums = score(rows, model, unseen, order)
    # A language is not part of a row's text: rows alike in id and text may differ in it.
    names = rows.select("doc_id", "text_key", "lang")
    scored = names.join(sums, same_row(names, sums)).select(names["doc_id"], names["text_key"], "lang", "loglik", "n_symbols")
    scored = materialize(scored, "scored")
    nll, n = -F.col("loglik"), F.col("n_symbols")
    known = scored.where(n > 1).where(~learn).join(ids, "doc_id", "left_semi")
    typical = known.groupBy(F.col("lang").alias("_lang")).agg((F.sum(nll) / F.sum(n)).alias("mu"))
    mean = known.agg((F.sum(nll) / F.sum(n)).alias("mu_all"))
    # Short texts are drawn towards their language's usual perplexity, as a few symbols say little.
    mu = F.coalesce("mu", "mu_all", F.lit(0.0))
    ppl = F.when(n > 1, F.exp((nll + prior * mu) / (n + F.when(F.col("mu_all").isNull(), 0).otherwise(prior))))
    scored = scored.join(F.broadcast(mean)).join(typical, F.col("lang") == F.col("_lang"), "left").select("doc_id", "text_key", "lang", ppl.alias("perplexity"))
    scored = materialize(scored, "perplexity")
    known = scored.where("perplexity is not null").where(~learn).join(ids, "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", quantile, 10000)
    per = known.groupBy(F.col("lang").alias("_lang")).agg(at.alias("own"))
    over_all = known.agg(at.alias("all"))
    out = scored.join(F.broadcast(over_all)).join(per, F.col("lang") == F.col("_lang"), "left")
    threshold = F.coalesce("own", "all")
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))
    return out.select("doc_id", "text_key", "lang", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
