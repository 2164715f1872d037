"""Documents to training sequences: five stages, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next one's docs.  All but the last keep the columns
of docs.  Nulls in any column, empty and very long texts, repeated rows, empty
tables and extra columns pass as the operators in strataq.llm define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import classifier, line_dedup, ngram_join, packing, suffix_dedup
from strataq.llm.common import cut, read_table, unused
from strataq.llm.queries import WORD_BPE

#: A document goes when it is this unlikely to be of good quality.
REJECT_BELOW = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  The labels' texts are the stage's own input."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model, score = classifier.fit(docs, labels), unused(docs, "quality_score")
    return classifier.score(docs, model, keep=docs.columns, score_col=score).filter(F.col(score) >= REJECT_BELOW).select(*docs.columns)


def line_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a twentieth of their source's documents go; the documents stay."""
    return line_dedup.line_dedup(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, Jaccard of 0.8 or more; of each group the least doc_id stays."""
    return ngram_join.keep_first(docs, n=5, num=4, den=5)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that start at two places or more go, in whole characters; the documents stay."""
    return suffix_dedup.remove_repeats(docs, length=200)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens in as few sequences of 4096 as found."""
    return packing.best_fit_packing(docs, tokenizer=WORD_BPE)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_boilerplate),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("best_fit_packing", sequences),
]

#: SQL cannot express the classifier and the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
