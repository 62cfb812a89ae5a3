"""Which hashes of a chunk stand in other chunks too: chunks send their distinct hashes to blocks of the hash space, which answer with bits.

A hash goes out once for each chunk, however often it stands there, so a common one can't crowd a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped, tidied, written

SENT = "block int, chunk long, hashes binary"


def bits_for(chunks: int) -> int:
    """The blocks grow with the chunks."""
    return min(30, max(4, (chunks - 1).bit_length()))


def _sent(chunk: int, block: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Values by ascending block; rows as in SENT."""
    at = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    parts = [part.tobytes() for part in np.split(values, at[1:])] if len(at) else []
    return pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int32)), pa.array(np.full(len(at), chunk)), pa.array(parts, pa.binary())], names=["block", "chunk", "hashes"])


def sent(chunk: int, distinct: np.ndarray, bits: int) -> pa.RecordBatch:
    """Ascending distinct hashes by block; rows as in SENT."""
    return _sent(chunk, distinct >> np.uint64(64 - bits), distinct)


def short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits by which counted() knows a hash: its block and 32 more."""
    return hashes >> np.uint64(32 - bits)


def sent_short(chunk: int, distinct: np.ndarray, bits: int) -> pa.RecordBatch:
    """Ascending distinct short() hashes by block, four bytes each; rows as in SENT."""
    return _sent(chunk, distinct >> np.uint64(32), distinct.astype(np.uint32))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    now, rows = None, []
    for batch in batches:
        for block, chunk, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now and rows:
                yield now, rows
                rows = []
            now = block
            rows.append((chunk, hashes))
    if rows:
        yield now, rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in _by_block(batches):
        flat = np.concatenate([np.frombuffer(h, np.uint32) for _, h in rows])
        flat.sort()
        heads = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        values, count = flat[heads], np.diff(np.append(heads, len(flat)))
        level = np.frexp(count.astype(np.float64))[1].astype(np.uint8)
        out = [pa.compress(level[np.searchsorted(values, np.frombuffer(h, np.uint32))].tobytes(), codec="zstd", asbytes=True) for _, h in rows]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([block] * len(rows), pa.int32()), pa.array([len(h) // 4 for _, h in rows], pa.int32()), pa.array(out, pa.binary())], names=["chunk", "block", "size", "levels"])


def counted(hashes: DataFrame) -> DataFrame:
    """chunk, answers for rows of sent_short(): for each hash the binary digits of the number of chunks that have it."""
    dealt = hashes.repartition("block").sortWithinPartitions("block")
    return written(dealt.mapInArrow(tidied(_count), "chunk long, block int, size int, levels binary").groupBy("chunk").agg(F.collect_list(F.struct("block", "size", "levels")).alias("answers")))


def levels(answers: list) -> np.ndarray:
    """The answers to a chunk, in the order of its hashes."""
    each = sorted(answers or [], key=lambda a: a["block"])
    return np.frombuffer(b"".join(pa.decompress(a["levels"], decompressed_size=a["size"], codec="zstd", asbytes=True) for a in each), np.uint8)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def answer(block: int, rows: list) -> pa.RecordBatch:
        flat = np.concatenate([np.frombuffer(h, np.uint64) for _, h in rows])
        _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared, at, out = count[back] > 1, 0, []
        for chunk, h in rows:
            mine = shared[at : at + len(h) // 8]
            at += len(h) // 8
            if mine.any():
                out.append((chunk, block, np.packbits(mine).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["chunk", "block", "bits"])

    for block, rows in _by_block(batches):
        yield answer(block, rows)


def answered(hashes: DataFrame) -> DataFrame:
    """chunk, answers for rows as in SENT, each chunk and block once."""
    dealt = hashes.repartition("block").sortWithinPartitions("block")
    return written(dealt.mapInArrow(tidied(_meet), "chunk long, block int, bits binary").groupBy("chunk").agg(F.collect_list(F.struct("block", "bits")).alias("answers")))


def shared(distinct: np.ndarray, answers: list | None, bits: int) -> np.ndarray:
    """Of the hashes that a chunk has sent, whether another chunk has them."""
    out, block = np.zeros(len(distinct), bool), distinct >> np.uint64(64 - bits)
    for answer in answers or []:
        a, b = np.searchsorted(block, answer["block"]), np.searchsorted(block, answer["block"], "right")
        out[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
    return out


shipped(__name__)
