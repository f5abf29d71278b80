"""The corpus queries by name, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers

from larkspur.llm import decontaminate, language, lines, media, merkle, mixing, packing, pii, quality, secrets, simhash, trie, urls
from larkspur.llm.common import materialize, table


def op3_packing(spark, sf_dir):
    """Every document's tokens in sequences of at most 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_language_id(spark, sf_dir):
    """The language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(language.learnable()))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_url_filters(spark, sf_dir):
    """A verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.labelled_pages(pages, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark, sf_dir):
    """Every document without its host's boilerplate lines."""
    found = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", F.col("n_dropped").cast("long").alias("n_dropped"), "text")


def op7_quality_classifier(spark, sf_dir):
    """Perplexity of every document under a model of trusted text, and whether it is kept."""
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "lang", "perplexity", "threshold", "keep")


def op8_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

OP6_SQL = (
    lines.SQL.format(docs="documents")
    + """SELECT d.doc_id, d.source, CAST(len(string_split(d.text, chr(10))) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM (
  SELECT d.*, list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR NOT coalesce(list_contains(h.bad, x), false)) AS kept
  FROM documents d LEFT JOIN held h ON h.source IS NOT DISTINCT FROM d.source) d"""
)


def op1_secret_scan(spark, sf_dir):
    """Secrets in every document."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_benchmark_decontamination(spark, sf_dir):
    """Words of every document that lie in a benchmark window, and the items they come from."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated")
    )


def op9_media_columns(spark, sf_dir):
    """Every document as baseline JPEG, and what its bytes give back."""
    found = media.jpeg_features(media.as_jpeg(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "width", "height"
    )


def op10_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op11_source_mixing(spark, sf_dir):
    """Every document's share of a mix of all sources by weight."""
    return mixing.mix_shares(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark, sf_dir):
    """Every document's leaf, roots and proof; half of the documents are shown without their newlines."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], shown={"text": tampered})


def op13_prefix_trie(spark, sf_dir):
    """Every node of the prefix trie of all rebuilt conversations."""
    return trie.nodes(trie.rebuilt(materialize(trie.sequences(table(spark, sf_dir, "conversations")), "sequences")))


def queries():
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_packing": op3_packing,
        "op4_language_id": op4_language_id,
        "op5_url_filters": op5_url_filters,
        "op6_line_dedup": op6_line_dedup,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_media_columns": op9_media_columns,
        "op10_pii": op10_pii,
        "op11_source_mixing": op11_source_mixing,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql():
    return {"op1_secret_scan": secrets.sql(), "op2_benchmark_decontamination": decontaminate.SQL, "op6_line_dedup": OP6_SQL, "op12_merkle_manifest": merkle.SQL, "op13_prefix_trie": trie.SQL}
