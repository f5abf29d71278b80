"""Personal data by bootstrapped contextual extraction.

Seed entities are what fixed patterns find (e-mail, IP, payment card, phone). The two words before an entity are a
lexical pattern. Patterns and instances (the values) form a bipartite graph over the whole corpus, also holding
tokens that look like identifiers but that no fixed pattern finds. Spark scores it in rounds: a pattern's confidence
for a kind is the share of its distinct instances that belong to the kind, an instance's is one less the product of
its patterns' doubts. Unseen identifiers after a pattern of high confidence and support are extracted as well.

Everything is DataFrame expressions. Only identifiers and the words before them are shuffled, never texts, and they
are aggregated to distinct (pattern, value) pairs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import keyed, let, materialize, running, same_row, spans, spelled, tagged

KINDS = ("email", "ip", "card", "phone")

# Matching from a run's start only, or from where the last match ended, gives the same matches without rescanning the
# run; possessive quantifiers keep long runs off the stack.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?+[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token that may be an identifier: at least six characters, one of them a digit.
_IDENTIFIER = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z0-9@._%+-]{6})[A-Za-z@._%+-]*+[0-9][A-Za-z0-9@._%+-]*+"
#: The two words at the end of a text, on the text reversed; quotes and brackets before an entity aren't part of them.
_TWO_WORDS = r"^[\s\"'(<]*+(\S++)\s++(\S++)"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    summed = F.aggregate(
        F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(2 * c.cast("int") / 10).cast("int"))), F.lit(0), lambda a, x: a + x
    )
    return summed % 10 == 0


def base_spans(text: Column, context=None) -> dict[str, Column]:
    """The fixed patterns' spans by kind, leftmost and not overlapping; failing matches are dropped, not retried."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>" if context is None else "array<struct<start:int,end:int,value:string,pattern:string>>")
    n = lambda x: F.length(_digits(x["value"]))
    ip = F.filter(spans(text, _IP, context), lambda x: F.forall(F.split(x["value"], r"\."), lambda p: p.cast("double") <= 255))
    card = F.filter(spans(text, _CARD, context), lambda x: F.when(n(x).between(12, 19), _luhn(_digits(x["value"]))).otherwise(False))
    return {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, _EMAIL, context)).otherwise(none),
        "ip": ip,
        "card": card,
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(spans(text, _PHONE, context), lambda x: n(x).between(9, 15))).otherwise(none),
    }


def _context(before: Column) -> Column:
    """The last two words of the text before a mention, lower-cased and with digits as 0; null where there are fewer."""
    back = F.reverse(before)
    two = F.concat_ws(" ", *[F.nullif(F.reverse(F.regexp_extract(back, _TWO_WORDS, n)), F.lit("")) for n in (2, 1)])
    return F.nullif(F.regexp_replace(F.lower(two), "[0-9]", "0"), F.lit(""))


def _free(tokens: Column, held: Column) -> Column:
    """The tokens that overlap no held span. Both are put in order of position, spans by start and tokens by end: a
    token is free if no span before it ends after its start."""
    nothing = F.lit(None).cast("struct<start:int,end:int,value:string,pattern:string>")
    events = F.concat(
        F.transform(held, lambda x: F.struct(x["start"].alias("at"), F.lit(1).alias("kind"), x["end"].alias("end"), nothing.alias("token"))),
        F.transform(tokens, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("end"), x.alias("token"))),
    )

    def untouched(ordered: Column) -> Column:
        last = running(F.transform(ordered, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        both = F.zip_with(ordered, last, lambda x, e: F.when((x["kind"] == 0) & (e <= x["token"]["start"]), x["token"]))
        return F.filter(both, lambda x: x.isNotNull())

    return F.when((F.size(tokens) == 0) | (F.size(held) == 0), tokens).otherwise(let(F.array_sort(events), untouched))


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, found, mentions) of keyed docs: the base spans by kind, and every seed or candidate mention
    as (kind or null, start, end, value, pattern)."""
    text = F.col("text")
    rows = docs.select("doc_id", "text_key", F.struct(*[c.alias(k) for k, c in base_spans(text, _context).items()]).alias("seen"), spans(text, _IDENTIFIER, _context).alias("tokens"))

    def mention(kind: str | None):
        return lambda x: F.struct(F.lit(kind).cast("string").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value"), x["pattern"].alias("pattern"))

    own = {k: F.col("seen")[k] for k in KINDS}
    plain = F.struct(*[F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))).alias(k) for k, c in own.items()])
    free = F.transform(_free(F.col("tokens"), F.concat(*own.values())), mention(None))
    return rows.select("doc_id", "text_key", plain.alias("found"), F.concat(*[F.transform(c, mention(k)) for k, c in own.items()], free).alias("mentions"))


def score_patterns(mentions: DataFrame, rounds: int = 2, prior: float = 1.0) -> DataFrame:
    """(pattern, and for each kind c_<kind> and n_<kind>): confidence and the weight of supporting instances.

    mentions has kind (null: unknown), value and pattern. Confidence is support / (distinct instances + prior).
    """
    edges = mentions.where("pattern is not null").groupBy("pattern", "value").agg(*[F.max((F.col("kind") == k).cast("double")).alias(f"s_{k}") for k in KINDS])
    edges = materialize(edges.select("pattern", "value", *[F.coalesce(f"s_{k}", F.lit(0.0)).alias(f"s_{k}") for k in KINDS]), "edges")
    belief = edges.groupBy("value").agg(*[F.max(f"s_{k}").alias(f"b_{k}") for k in KINDS])
    pairs = edges.select("pattern", "value")
    for last in range(rounds, -1, -1):
        held = pairs.join(belief, "value").groupBy("pattern").agg(F.count("*").alias("n"), *[F.sum(f"b_{k}").alias(f"n_{k}") for k in KINDS])
        patterns = held.select("pattern", *[f"n_{k}" for k in KINDS], *[(F.col(f"n_{k}") / (F.col("n") + prior)).alias(f"c_{k}") for k in KINDS])
        patterns = materialize(patterns, "patterns")
        if last:
            doubt = [F.sum(F.log1p(-F.least(F.col(f"c_{k}"), F.lit(0.99)))).alias(f"d_{k}") for k in KINDS]
            joined = edges.join(patterns.select("pattern", *[f"c_{k}" for k in KINDS]), "pattern")
            belief = joined.groupBy("value").agg(*doubt, *[F.max(f"s_{k}").alias(f"s_{k}") for k in KINDS])
            belief = belief.select("value", *[F.greatest(F.col(f"s_{k}"), 1 - F.exp(f"d_{k}")).alias(f"b_{k}") for k in KINDS])
            belief = materialize(belief, "belief")
    return patterns


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, confidence: float = 0.7, support: float = 3.0) -> DataFrame:
    """(doc_id, text_key, found, extra) for every row of docs; found holds the base spans by kind, extra the spans
    (start, kind, end) of identifiers discovered by patterns of at least this confidence and supporting weight.

    Null texts count as empty and have no spans. Repeated rows each keep their row; rows that share a doc_id, or have
    none, are told apart by their text. Other columns are not read. A corpus without seeds discovers nothing.
    """
    held = materialize(extract(keyed(docs, id_col, text_col)), "mentions")
    mentions = held.select("doc_id", "text_key", F.explode("mentions").alias("m")).select("doc_id", "text_key", "m.*")
    patterns = score_patterns(mentions, rounds)
    best = F.greatest(*[F.struct(F.col(f"c_{k}").alias("c"), F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in KINDS])
    trusted = patterns.select("pattern", best.alias("best")).where((F.col("best.c") >= confidence) & (F.col("best.n") >= support)).select("pattern", F.col("best.kind").alias("as"))
    unseen = mentions.where("kind is null and pattern is not null").join(trusted, "pattern")
    extra = unseen.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", F.col("as").alias("kind"), "end")).alias("extra"))
    rows = held.select("doc_id", "text_key", "found")
    joined = rows.join(extra, same_row(rows, extra), "left")
    return joined.select(rows["doc_id"], rows["text_key"], "found", F.coalesce("extra", F.array().cast("array<struct<start:int,kind:string,end:int>>")).alias("extra"))


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the base spans' SHA-256 and all spans spelled out, from scan()'s rows. Discovered
    spans have kinds like context_email, listed after the base kinds."""
    base = F.concat(*[tagged(F.col("found")[k], k, n) for n, k in enumerate(KINDS)])
    more = F.transform(
        "extra",
        lambda x: F.struct(x["start"].alias("start"), (len(KINDS) + F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])).cast("int").alias("order"), F.concat(F.lit("context_"), x["kind"]).alias("kind"), x["end"].alias("end")),
    )
    return found.select(
        "doc_id", *[F.size(F.col("found")[k]).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.concat(base, more)).alias("spans")
    )
