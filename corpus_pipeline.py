"""From raw documents to packed sequences: one operator of inkwell.llm a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each stage's rows as
Parquet in the shared folder and reads them again. All stages but the last return the columns of documents.

A null text counts as empty: it is scored, folded with other empty ones, has no near copies, no spans and one token, its end.
Null doc_ids are ids like others, which come last where the least is chosen. Of rows that repeat a doc_id and a text one
stays; with different texts each is judged for itself. Ties go to the least doc_id. Texts may have any length, further
columns pass through the first four stages whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import exact_dedup, ngram_jaccard, packing, pii, quality
from inkwell.llm.common import written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by labels, gives a score of quality.CUT or more."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.dedupe(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group linked by the Jaccard similarity of their five-word shingles."""
    return ngram_jaccard.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: The classifier's and the tokenizer's results can't be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
