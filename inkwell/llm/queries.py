"""One query per operator, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, embedding_dedup, exact_dedup, filter_audit, line_dedup, ngram_jaccard, packing, pii, piece_codec, quality, sharding, substring, token_files
from .common import scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.join(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in eight arrivals, compacted and read back: doc_id, text_sha256, shard, shard_bytes."""
    docs = _table(spark, sf_dir, "documents")
    store = sharding.ShardStore.create(spark, scratch(spark), docs.schema)
    store.append_arrivals(docs, F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 8), 8)
    store.compact()
    return store.read().select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "shard", "shard_bytes")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of token ids, read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch(spark)
    token_files.write(_table(spark, sf_dir, "documents"), path)
    return token_files.checksums(spark, path)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op3_packing": op3_packing,
    "op4_sentencepiece_codec": op4_sentencepiece_codec,
    "op7_quality_classifier": op7_quality_classifier,
    "op2_pii": op2_pii,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_line_dedup": op6_line_dedup,
    "op10_sharding": op10_sharding,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_files": op12_token_files,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op5_ngram_jaccard": ngram_jaccard.SQL,
    "op8_embedding_dedup": embedding_dedup.SQL,
    "op9_substring_dedup": substring.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_conversation_trie": conversation_trie.SQL,
}
