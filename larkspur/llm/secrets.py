"""Secret scans with a trigram inverted index.

Each rule's regex is reduced to a Boolean trigram query: an OR of ANDs of lower-cased trigrams that any match must
contain. Postings (trigram -> documents) are built for the trigrams that some query names; intersecting them gives
each rule's candidate documents, and only those are searched with the regex. Rules without mandatory trigrams scan
every document. All of the data work is DataFrame expressions; only the rules are analysed in Python, on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import keyed, materialize, same_row, spans, spelled, tagged

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex that Java and Python read alike, and the least length of what it must capture."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The base rules, in the order in which kinds are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Further rules, for the published shapes of common credentials.
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@"),
)
#: At most so many alternatives are multiplied out; a part beyond that adds no trigrams.
_MOST = 64


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Sets of lower-cased trigrams, of which every match holds at least one whole set; None if there are none."""
    found = [frozenset(t for run in way for t in (run[i : i + 3] for i in range(len(run) - 2))) for way in _ways(sre_parse.parse(regex))]
    smallest = [s for s in set(found) if not any(o < s for o in found)]
    return sorted(smallest, key=sorted) if found and all(found) else None


def _ways(parsed) -> list[tuple[str, ...]]:
    """Alternative lists of literal runs that a match contains, in order; '' breaks a run."""
    ways: list[tuple[str, ...]] = [("",)]
    for op, value in parsed:
        parts = _parts(op, value)
        if len(ways) * len(parts) > _MOST:
            parts = [("", "")]
        ways = [(*a[:-1], a[-1] + b[0], *b[1:]) for a, b in product(ways, parts)]
    return ways


def _parts(op, value) -> list[tuple[str, ...]]:
    if op is sre.LITERAL:
        return [(chr(value).lower(),)]
    if op is sre.SUBPATTERN:
        return _ways(value[-1])
    if op is sre.BRANCH:
        found = [w for branch in value[1] for w in _ways(branch)]
        return found if len(found) <= _MOST else [("", "")]
    if op is sre.IN and all(k is sre.LITERAL for k, _ in value) and len(value) <= 8:
        return [(c,) for c in sorted({chr(v).lower() for _, v in value})]
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = value
        if low == 0 and high == 1:
            return [("",), *_ways(body)]
        if low == high and low <= 8:
            return _ways([x for _ in range(low) for x in body])
        if low:
            return [(*w, "") for w in _ways(body)]
    return [("", "")]


def _queries(rules: tuple[Rule, ...]) -> dict[str, list[frozenset[str]] | None]:
    return {r.kind: trigram_query(r.regex) for r in rules}


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, doc_id, text_key) for each of the given lower-cased trigrams in a document's text."""
    low = F.lower("text")
    held = F.filter(F.array(*map(F.lit, trigrams)) if trigrams else F.array().cast("array<string>"), lambda t: F.contains(F.col("_low"), t))
    return docs.withColumn("_low", low).select("doc_id", "text_key", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, text_key, kinds): the rules whose trigram query a document's postings meet."""
    clauses = [(r, n, t, len(q)) for r, qs in _queries(rules).items() for n, q in enumerate(qs or []) for t in sorted(q)]
    # The rules' clauses are a constant of the program: a few hundred rows at most.
    wanted = docs.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, needed int")
    met = postings(docs, sorted({c[2] for c in clauses})).join(F.broadcast(wanted), "trigram")
    met = met.groupBy("doc_id", "text_key", "kind", "clause").agg(F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return met.groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("kinds"))


def _found(rule: Rule, text: Column) -> Column:
    """The rule's spans in a text: leftmost, not overlapping, failing ones dropped."""
    if rule.kind == "hex":  # runs of the class, so a shorter match is never part of a longer one
        return spans(text, "[0-9a-f]{%d,}" % rule.least)
    every = spans(text, rule.regex)
    size = lambda x: F.length(F.regexp_extract(x["value"], rule.regex, rule.group))
    return F.filter(every, lambda x: size(x) >= rule.least) if rule.least > 1 else every


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """(doc_id, text_key, found) for every row of docs; found has one field for each rule, the array of its spans.

    Null texts count as empty and have no spans. Repeated rows each keep their row; rows that share a doc_id, or have
    none, are told apart by their text. Other columns are not read.
    """
    rules = (*base, *extra)
    rows = keyed(docs, id_col, text_col)
    needs = {k for k, q in _queries(rules).items() if q is not None}
    hits = materialize(candidates(rows, tuple(r for r in rules if r.kind in needs)), "candidates")
    rows = rows.join(hits, same_row(rows, hits), "left").select(rows["doc_id"], rows["text_key"], "text", "kinds")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    held = [F.when(F.array_contains("kinds", r.kind), _found(r, F.col("text"))).otherwise(none) if r.kind in needs else _found(r, F.col("text")) for r in rules]
    return rows.select("doc_id", "text_key", F.struct(*[h.alias(r.kind) for h, r in zip(held, rules, strict=True)]).alias("found"))


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """Counts of the base kinds, the base spans' SHA-256 and all spans spelled out, from scan()'s rows."""
    tags = {r.kind: tagged(F.col("found")[r.kind], r.kind, n) for n, r in enumerate((*base, *extra))}
    own = F.concat(*[tags[r.kind] for r in base])
    return found.select(
        "doc_id",
        *[F.size(F.col("found")[r.kind]).cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(spelled(own), 256).alias("base_sha256"),
        spelled(F.concat(*tags.values())).alias("spans"),
    )


def _sql_spans(rule: Rule) -> str:
    """A DuckDB list of {start, end} of a rule's spans in `t`."""
    regex = rule.regex.replace("'", "''")
    size = f"length(regexp_extract(m[i], '{regex}', {rule.group}))"
    before = "list_sum(list_transform(b[1:i], lambda x: length(x)))"
    at = f"CAST({before} + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    every = f"list_transform(list_filter(range(1, len(m) + 1), lambda i: {size} >= {rule.least}), lambda i: {{'s': {at}, 'e': {at} + length(m[i])}})"
    return f"(SELECT {every} FROM (SELECT regexp_extract_all(t, '{regex}') AS m, string_split_regex(t, '{regex}') AS b))"


def sql(base: tuple[Rule, ...] = BASE, extra: tuple[Rule, ...] = EXTRA) -> str:
    """DuckDB SQL for digest(scan(documents)): every rule over every text, without an index."""
    rules = (*base, *extra)
    found = ", ".join(f"{_sql_spans(r)} AS {r.kind}" for r in rules)
    tag = lambda rs: " || ".join(f"list_transform({r.kind}, lambda x: {{'s': x.s, 'o': {rules.index(r)}, 't': concat('{r.kind}:', x.s, ':', x.e)}})" for r in rs)
    spell = lambda rs: f"coalesce(array_to_string(list_transform(list_sort({tag(rs)}), lambda x: x.t), ','), '')"
    counts = ", ".join(f"CAST(len({r.kind}) AS BIGINT) AS n_{r.kind}" for r in base)
    return f"SELECT doc_id, {counts}, sha256({spell(base)}) AS base_sha256, {spell(rules)} AS spans FROM (SELECT doc_id, {found} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"
