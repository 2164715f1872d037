"""The registered query of each training-data operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, classifier, exact_dedup, line_dedup, ngram_join, order_minhash, packing, prefix_trie, rules, suffix_dedup, url_filter, warc
from .common import read_table

#: (verdict, host, path prefix)
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ENGLISH_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text (null: empty), mod 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the quality label of the document it shows, whose id is the last number of its path."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.nullif(F.regexp_extract(url_filter.url_path(F.col("url")), "([0-9]+)[^0-9]*$", 1), F.lit(""))
    shown = pages.select(url_filter.url_host(F.col("url")).alias("host"), number.try_cast("long").alias("doc_id"))
    outcomes = shown.join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("host", "quality")
    return url_filter.url_filter(pages, outcomes, URL_RULES)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return rules.quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=9, den=10)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", "quality")
    scored = classifier.score(docs, classifier.fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.roundtrip_digests(docs, vocabulary=BYTE_BPE, pattern=public_tokenizers.PATTERN)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer=WORD_BPE)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), path_a=ENGLISH_BPE, path_b=PIECES)


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.coded_turns(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.prefix_trie(*prefix_trie.share_heads(turns)).drop("preorder", "subtree_end")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
