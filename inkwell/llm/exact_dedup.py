"""Exact deduplication by counting quotient filters.

A fingerprint of 64 bits splits into a quotient (its upper bits, the block) and a remainder. Each partition of the
input builds its own filter: per block the sorted remainders with their counts. Filters merge without loss, block by
block, as sorted runs whose counts add up. Fingerprints whose merged count is above one are candidates; only
candidates go to the verification, which groups them by their whole normalised text.

Texts are equal when identical after deleting every blank of [\\x20\\x09-\\x0D]; null counts as empty. Of equal texts
the row with the most code points, then the smallest doc_id (null last) stays. Rows that repeat a doc_id with equal
texts share one verdict. Texts may have any length: fingerprints, digests and groups take them whole. An empty table gives an empty
result. Further columns don't take part; `dedupe` keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_row_each, plain_names, shipped, sifted, tidied, written

#: The quotient's bits: filters are dealt out in 2**bits blocks, of about 2**BLOCK_SIZE_BITS rows each in a large corpus.
LEAST_BITS, BLOCK_SIZE_BITS = 12, 13


def normalised(text: str = "text") -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _merge(remainders: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(remainders, kind="stable")  # runs that are sorted already merge in one sweep
    remainders, counts = remainders[order], counts[order]
    heads = np.flatnonzero(np.append(True, remainders[1:] != remainders[:-1])) if len(remainders) else np.zeros(0, np.int64)
    return remainders[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _build(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A partition's filter: block, sorted remainders, counts."""
    runs = []
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        runs.append(_merge(prints, np.ones(len(prints), np.int64)))
        while len(runs) > 1 and len(runs[-2][0]) <= 2 * len(runs[-1][0]):
            a, b = runs.pop(), runs.pop()
            runs.append(_merge(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])))
    if not runs:
        return
    prints, counts = _merge(np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs]))
    blocks = (prints >> np.uint64(64 - bits)).astype(np.int32)
    heads = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
    ends = np.append(heads[1:], len(prints))
    low = prints & np.uint64((1 << (64 - bits)) - 1)
    yield pa.RecordBatch.from_arrays([pa.array(blocks[heads]), pa.array([low[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary())], names=["block", "remainders", "counts"])


def _merge_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Merged filters of whole blocks, whose rows arrive together and in order; gives the fingerprints counted more than once."""

    def repeated(block: int, rows: list) -> pa.RecordBatch:
        low = np.concatenate([np.frombuffer(r, np.uint64) for r, _ in rows])
        low, counts = _merge(low, np.concatenate([np.frombuffer(c, np.int64) for _, c in rows]))
        prints = (low[counts > 1] | np.uint64(block << (64 - bits))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(prints), pa.array(counts[counts > 1])], names=["fp", "n"])

    now, rows = None, []
    for batch in batches:
        for block, remainders, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now and rows:
                yield repeated(now, rows)
                rows = []
            now = block
            rows.append((remainders, counts))
    if rows:
        yield repeated(now, rows)


def repeated_fingerprints(prints: DataFrame, column: str = "fp") -> DataFrame:
    """fp, n of the fingerprints that stand in more than one row of a table, by merged counting quotient filters."""
    bits = min(30, max(LEAST_BITS, prints.count().bit_length() - BLOCK_SIZE_BITS))
    filters = prints.select(column).mapInArrow(tidied(lambda b: _build(b, bits)), "block int, remainders binary, counts binary")
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(tidied(lambda b: _merge_blocks(b, bits)), "fp long, n long")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text)."""
    prepared = docs.select("doc_id", normalised().alias("plain"), F.length(F.coalesce("text", F.lit(""))).alias("points"))
    narrow = written(prepared.select("doc_id", "points", F.xxhash64("plain").alias("fp"), F.sha2("plain", 256).alias("text_sha256")))
    candidates = written(repeated_fingerprints(narrow))  # a table, so that its size decides how it is joined
    # A sieve holds back most other texts where they are: joined at once, all of them would be moved.
    again = sifted(prepared.select("doc_id", "plain", "points", F.xxhash64("plain").alias("fp")), "fp", candidates.select("fp")).join(candidates.select("fp"), "fp", "left_semi")
    # The key is the whole normalised text: equal fingerprints alone don't make a group. The first pass folds the copies of a
    # task, so a hot group sends a row per task and length.
    longest = again.groupBy("plain", "points").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    groups = longest.groupBy("plain").agg(F.max(F.struct("points", F.coalesce(-F.col("doc_id"), F.lit(-(2**63))).alias("first"), "doc_id")).alias("best"), F.sum("n").alias("n"))
    groups = groups.filter("n > 1").select(F.sha2("plain", 256).alias("text_sha256"), F.col("best.doc_id").alias("best_id"), "n")
    out = narrow.join(written(groups), "text_sha256", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


@plain_names("doc_id", "text")
def dedupe(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat a kept doc_id and its text one stays."""
    told = written(verdicts(docs).withColumnRenamed("text_sha256", "digest"))
    twins = told.filter("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    named = told.filter("NOT kept").select("doc_id", "digest", F.lit(False).alias("stays")).unionByName(twins.select("doc_id", "digest", F.lit(True).alias("stays")))
    return one_row_each(docs, F.sha2(normalised(), 256), named)


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(plain) AS text_sha256
FROM d WINDOW w AS (PARTITION BY plain ORDER BY points DESC, doc_id)
"""

shipped(__name__)
