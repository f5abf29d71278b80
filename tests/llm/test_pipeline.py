"""The pipeline's stages over small folders with nulls and copies, and against a plain version."""

import random
import sys
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import language, queries

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import _contamination, _nearest  # noqa: E402


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == corpus_pipeline.COLUMNS, name
        counts.append(docs.count())
    assert counts[1] >= 0.98 * counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] < counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == counts[4]


def _shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _plain_dedup(rows):
    """(doc_id, text) rows, one of each component of pairs with a shingle similarity of 0.8 or more."""
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a == b or 10 * len(a & b) >= 8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    best = {}
    for r, (i, _) in zip(root, rows, strict=True):
        best[r] = min(best.get(r, i), i)
    return [x for x in rows if x[0] in best.values()]


def _plain_lines(rows):
    """(doc_id, text, source) without lines on over 1 % and at least five of a host's different pages."""
    out, pages = [], {}
    for _, t, s in rows:
        pages.setdefault(s, set()).add(t)
    for i, t, s in rows:
        bad = {x for x in t.split("\n") if x.strip(" ") and (n := sum(x in p.split("\n") for p in pages[s])) >= 5 and n > 0.01 * len(pages[s])}
        out.append((i, "\n".join(x for x in t.split("\n") if x not in bad)))
    return out


def test_pipeline_as_plain(spark, tmp_path):
    r = random.Random(21)
    words = {x: [f"{a}{b}" for a in ("str", "mel", "quo", "ban", "wix", "fjo") for b in ends] for x, ends in (("en", ("ing", "ed", "th")), ("de", ("ung", "keit", "sch")))}
    prose = lambda x, n: " ".join(r.choice(words[x]) for _ in range(n))
    passage, rows = prose("en", 40), []
    for i in range(90):
        x = "en" if i % 2 else "de"
        text = f"{prose(x, 30)}\n{prose(x, 30)}\nMENU {i % 3}"
        if rows and i % 6 == 0:
            text = rows[r.randrange(len(rows))][1].replace("MENU", "MENU" if i % 12 else "FOOT")
        if i % 7 == 0 and text:
            w = text.split(" ")
            w[r.randrange(len(w) - 2)] = "changed"
            text = " ".join(w)
        if i % 11 == 0:
            text += " " + passage[: r.randint(60, 200)]
        rows.append((i, text, x, f"h{i % 4}", len(text)))
    rows += [(200, "0123 4567 \u2014", "en", "h0", 11), (201, "", "en", "h1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = [(1, passage), (2, "quoing bansch")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    model = language.fit(docs.where(language.learnable()))
    kept = [(i, t, s) for i, t, _, s, _ in rows if not _nearest(t, model)[2]]
    kept = _plain_dedup(_plain_lines(kept))
    bad = {i for i, n, hit, _ in _contamination(kept, bench) if hit and 20 * hit >= n}
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept if i not in bad}
    assert 30 < len(want) < len(kept) < len(rows) - 2
    assert got.groupby("doc_id").length.sum().to_dict() == want == got.groupby("doc_id").doc_tokens.first().to_dict()
    assert got.groupby("sequence_id").length.sum().max() <= 2048


def test_pipeline_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.isEmpty()
        if "doc_id" not in docs.columns or "text" not in docs.columns:
            break


def test_copies_keep_their_text(spark, sf_dir):
    text = "\n".join(f"line {i} of a text that has many copies" for i in range(9))
    rows = [(i, f"{text}\nMENU" if i < 40 else f"page {i} says {i * i}\nMENU", "en", "hot", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.line_dedup(spark, docs, sf_dir)
    got = {r.doc_id: r.text for r in out.collect()}
    assert len(got) == 60 and all(got[i] == text for i in range(40)) and got[59] == "page 59 says 3481"
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, out, sf_dir).collect()}
    assert kept[0] == text and not {*range(1, 40)} & {*kept}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_runs(spark, sf_dir, name):
    table = {"op5_url_filters": "pages", "op13_prefix_trie": "conversations"}.get(name, "documents")
    given = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    n = given.select("conv_id").distinct().count() if table == "conversations" else given.count()  # a trie has a node for each at least
    rows = queries.queries()[name](spark, sf_dir)
    assert rows.count() >= n
