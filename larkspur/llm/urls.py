"""URL filters by association rules.

Labelled URLs become transactions of tokens (host labels, path parts, query keys) and their label. Tokens that occur in
the same labelled URLs only are one item, as FP-growth would list every combination of them. Spark's FP-growth mines
combinations on at least LEAST_ROWS labelled rows; a rule from items to a label is kept if its confidence is high enough
and the lower end of that confidence's interval is above the label's share of all rows, so that a chance finding on a few
rows is none, and dropped where a shorter rule is as sure. Rules match pages through an inverted index: each rule is posted
under the tokens of its item on the fewest labelled rows, so a page meets only the rules of its own tokens, and the rest
is then verified.

FP-growth's combinations have no bound of their own: tokens that often, but not always, go together multiply. The floor
on rows and the share `support` are what holds them.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import materialize, small

ALLOW, BLOCK = "allow", "block"
#: Fixed rules: (host, path, verdict).
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))
#: Labelled rows that a rule holds for, at least, and the deviations of its confidence's interval (95 %).
LEAST_ROWS, DEVIATIONS = 10, 1.96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without a ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null if none does."""
    fits = None
    for h, p, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        here = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(here, value) if fits is None else fits.when(here, value)
    return fits


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: host labels, parts of the path with digits as #, and query keys."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = lambda c, cut, tag: F.transform(F.filter(F.split(c, cut), lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(parts(host, r"\.", "h:"), parts(F.regexp_replace(path, "[0-9]+", "#"), "/", "p:"), keys))


def _items(rows: DataFrame, least: float) -> DataFrame:
    """(token, item, members, n) for tokens on at least `least` of the rows (id, tokens), n of them; tokens of the same rows
    share an item.

    There are at most (tokens of an average URL) * rows / least of them.
    """
    by = rows.select("id", F.explode("tokens").alias("token")).groupBy("token")
    same = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"s{k}") for k in (0, 1)]
    often = materialize(by.agg(F.count("*").alias("n"), *same).where(F.col("n") >= least), "tokens")
    sets = often.groupBy("n", "s0", "s1").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return materialize(sets.select(F.explode("members").alias("token"), F.col("members")[0].alias("item"), "members", "n"), "items")


def surety(hits: Column, n: Column) -> Column:
    """The lower end of the interval (Wilson's) of a share of hits in n rows."""
    z = DEVIATIONS**2
    share = hits / n
    return (share + z / (2 * n) - DEVIATIONS * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def mine(labelled: DataFrame, support: float = 0.001, confidence: float = 0.5, url_col: str = "url", label_col: str = "label", least_rows: int = LEAST_ROWS) -> DataFrame:
    """(rule_id, antecedent, posted, label, confidence, surety, support) from rows with a URL and a label; antecedent is an
    array of items, each the array of its tokens, and posted the item on the fewest rows (ties: the smaller one).

    support is a share of the labelled rows, and a rule must hold for at least least_rows of them. A rule must be surer
    than the label's own share. No labelled rows, or fewer than least_rows: no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull())
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("id"), tokens(F.col(url_col)).alias("tokens"), F.concat(F.lit("="), F.col(label_col)).alias("label")), "labelled")
    n = rows.count()
    if n < least_rows or not n:
        return spark.createDataFrame([], "rule_id long, antecedent array<array<string>>, posted array<string>, label string, confidence double, surety double, support double")
    share = max(support, least_rows / n)
    items = _items(rows, share * n)
    held = rows.select("id", F.explode("tokens").alias("token")).join(items.select("token", "item"), "token").groupBy("id").agg(F.collect_set("item").alias("held"))
    baskets = rows.select("id", "label").join(held, "id", "left").select(F.concat(F.coalesce("held", F.array().cast("array<string>")), F.array("label")).alias("items"))
    # A little less than the share, as it is rounded up to rows.
    model = FPGrowth(itemsCol="items", minSupport=share - 0.5 / n, minConfidence=confidence).fit(baskets)
    label = F.element_at("consequent", 1)
    found = model.associationRules.where(label.startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    hits = F.round(F.col("support") * n)
    found = found.withColumn("surety", surety(hits, F.round(hits / F.col("confidence")))).where(F.col("surety") > F.col("confidence") / F.col("lift"))
    found = materialize(found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(label, 2, 1000).alias("label"), "confidence", "surety", "support"), "rules")
    # A rule is of no use if a part of its combination gives the same label as surely: look each part up.
    short = found.select(F.col("antecedent").alias("part"), F.col("label").alias("_label"), F.col("surety").alias("_surety"))
    parts = found.where(F.size("antecedent") > 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("antecedent") - 1)))
    parts = parts.withColumn("part", F.filter("antecedent", lambda x, j: j != F.col("i")))
    beaten = parts.join(short, (parts["part"] == short["part"]) & (parts["label"] == short["_label"]) & (short["_surety"] >= parts["surety"])).select("antecedent", "label").distinct()
    kept = found.join(beaten, ["antecedent", "label"], "left_anti").withColumn("rule_id", F.xxhash64("antecedent", "label"))
    members = items.select("item", "members", "n").distinct()
    names = ["rule_id", "label", "confidence", "surety", "support"]
    whole = kept.select(*names, F.explode("antecedent").alias("item")).join(members, "item")
    whole = whole.groupBy(*names).agg(F.array_sort(F.collect_list("members")).alias("antecedent"), F.min(F.struct("n", "members")).alias("rare"))
    return materialize(whole.select("rule_id", "antecedent", F.col("rare.members").alias("posted"), "label", "confidence", "surety", "support"), "kept")


def match(pages: DataFrame, rules: DataFrame, key: str = "url") -> DataFrame:
    """(url, mined, rule_id, confidence) of the surest rule of whose every item a distinct URL has a token; rules as sure
    are taken by the number of their items, the larger first, then by label and rule_id, the larger first.

    Only numbers of URLs and tokens meet the index; a URL's whole tokens meet the rules that it was found for.
    """
    urls = pages.select(F.col(key).alias("url")).where("url is not null").distinct().withColumns({"id": F.monotonically_increasing_id(), "tokens": tokens(F.col("url"))})
    urls = materialize(urls, "urls")
    index = small(materialize(rules.select(F.explode("posted").alias("token"), "rule_id"), "index"))
    hits = urls.select("id", F.explode("tokens").alias("token")).join(index, "token").select("id", "rule_id").distinct()
    asked = urls.select("id", "tokens").join(materialize(hits, "hits"), "id").join(small(rules), "rule_id")
    met = asked.where(F.forall("antecedent", lambda item: F.arrays_overlap(item, "tokens")))
    best = F.max(F.struct("surety", F.size("antecedent").alias("n"), "label", "rule_id", "confidence"))
    found = met.groupBy("id").agg(best.alias("b"))
    return urls.select("id", "url").join(found, "id").select("url", F.col("b.label").alias("mined"), F.col("b.rule_id").alias("rule_id"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, labelled: DataFrame, fixed=RULES, support: float = 0.001, confidence: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_confidence) for every row of pages.

    A fixed rule's verdict wins, the longest rule first; else the surest mined rule's (ties: see match); else allow. A null
    URL, or one without ://, has an empty host and path; no pages give no rows. Repeated rows and null ids keep their rows; other columns are not read.
    labelled has a URL and a label, allow or block; it may be empty.
    """
    found = match(pages, mine(labelled, support, confidence))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    rows = rows.join(found, rows["_url"] == found["url"], "left")
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "mined", "confidence")
    rows = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    return rows.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", "mined", F.lit(ALLOW)).alias("verdict"), F.col("confidence").alias("mined_confidence"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs of pages whose document is labelled: block if it is of low quality or toxic, else allow."""
    labels = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), BLOCK).otherwise(ALLOW).alias("label"))
    return pages.select("page_id", "url").join(labels, "page_id").select("url", "label")
