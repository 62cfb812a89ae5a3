"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

The ids of all documents are counted, and each id is known in the files by its rank, the commonest as 0. A rank takes one to
four bytes, so the 256 commonest ids take one; two bits for each rank, four ranks in a control byte, tell how many. Control
bytes and data bytes stand apart, so numpy decodes whole blocks: a table gives the four lengths of a control byte, their sums
the places, another table the bits to keep of four bytes read from each place, and the last one the id of each rank.

Files. `path/blocks` holds the ids in ascending order of doc_id (null first; rows that repeat a doc_id in the order in which
they were read). A block has whole documents, up to `block_tokens` ids or one longer document, and is a row of Parquet: part and
seq (its place), start (ids before it in its part), doc_ids and lengths (its documents and their numbers of ids), control and
data. Each part is a file, written by one task and committed by Spark's writer, so a lost executor's task is written again and
readers never see half a file. `path/parts` has the ids before each part, `path/ranks` the id of each rank and its count. All
of it lies in whatever file system the path names.

Each text is tokenized once, and only its ids move. Parts are ranges of (doc_id, place in the input), so neither a doc_id that
many rows have nor rows without one crowd a part. A null text counts as empty and has the end id alone. Texts may have any length.
An empty table makes files without blocks. Only doc_id and text are read, whatever other columns there are. The tokenizer is
applied to distinct words, known by 64-bit hashes: n of these hold a false match with a chance of n*n / 2**65.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_table import per_process
from .common import scratch, shipped, slices, small_batches, tabled, tidied, totals
from .hashing import raw
from .packing import WordIds, default_tokenizer

END_ID = 2
#: Ids of a block, if its documents aren't longer.
BLOCK_TOKENS = 1 << 18
#: Ids of a part at least and at most, about; between them there are as many parts as shuffle partitions.
LEAST_TOKENS, MOST_TOKENS = 1 << 22, 1 << 26
BLOCKS = "part int, seq int, start long, doc_ids array<bigint>, lengths array<int>, control binary, data binary"
_BYTES = np.arange(4)
#: The four lengths that a control byte tells.
LENGTHS = (((np.arange(256)[:, None] >> (2 * _BYTES)) & 3) + 1).astype(np.uint8)
#: The bits of four little-endian bytes that a rank of so many bytes has.
BITS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def packed(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    codes[: len(ranks)] = more
    control = (codes.reshape(-1, 4) << (2 * _BYTES).astype(np.uint8)).sum(1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[_BYTES <= more[:, None]]
    return control.tobytes(), data.tobytes()


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    padded = data + b"\0\0\0\0"
    four = np.ndarray((len(data) + 1,), "<u4", buffer=padded, strides=(1,))  # the four bytes from each place on
    return four[ends - lengths] & BITS[lengths]


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """row (partition and place in it), doc_id, n, ids (their bytes, zstd) of each document; and rows with the partition's counts of ids, in parts (block, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = per_process(("word_ids", tokenizer), lambda: WordIds(tokenizer))
        size = max(words.tokenizer.get_vocab_size(), end_id + 1)
        wide = "<u2" if size <= 1 << 16 else "<u4"
        counts, end = np.zeros(size, np.int64), np.array([end_id])
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        names = ["row", "doc_id", "n", "ids", "block", "counts"]
        for part in slices(batches):
            text = part.column(1)
            ids, ends, _ = words.encode(text)
            odd = b"<|" in raw(text)[0].tobytes()  # only there can a special token's own text stand
            found = []
            for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                mine = ids[a:b]
                if odd and "<|" in (value := text[i].as_py()):
                    mine = np.array(words.special(value), np.int64)
                found.append(np.concatenate([mine, end]).astype(wide))
            counts += np.bincount(np.concatenate(found), minlength=size)
            out = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in found]
            lengths, n = [len(x) for x in found], len(found)
            none = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), part.column(0), pa.array(lengths, pa.int64()), pa.array(out, pa.binary()), *none], names=names)
            row += n
        if counts.any():
            for part in tabled(counts):
                n = part.num_rows
                none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, part.column(0), part.column(1)], names=names)

    texts = small_batches(docs).select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(tidied(run), "row long, doc_id long, n long, ids binary, block int, counts binary")


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> None:
    """The ids of docs (doc_id, text), each document's end_id with them, as files under path, which must be new."""
    from tokenizers import Tokenizer

    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    wide = "<u2" if size <= 1 << 16 else "<u4"
    kept = scratch(spark)
    _tokenized(docs, tokenizer, end_id).write.option("compression", "uncompressed").parquet(kept)
    table = spark.read.parquet(kept)
    counts = totals(table.filter("block IS NOT NULL").select("block", "counts"), size)  # one number for each id of the vocabulary
    order = np.lexsort([np.arange(size), -counts])
    rank = np.empty(size, np.uint32)
    rank[order] = np.arange(size)
    spark.createDataFrame([(i, int(t), int(counts[t])) for i, t in enumerate(order)], "rank int, id int, n long").coalesce(1).write.parquet(f"{path}/ranks")
    known = spark.sparkContext.broadcast(rank)
    total, most = int(counts.sum()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-total // MOST_TOKENS), min(most, -(-total // LEAST_TOKENS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        tokens = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(pa.decompress(x, decompressed_size=n * int(wide[2]), codec="zstd", asbytes=True), wide) for _, n, x in held])
            control, data = packed(known.value[ids])
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())), pa.array([[n for _, n, _ in held]], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=["part", "seq", "start", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for doc, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and tokens + n > block_tokens:
                    yield block()
                    seq, start, held, tokens = seq + 1, start + tokens, [], 0
                held.append((doc, n, ids))
                tokens += n
        if held:
            yield block()

    ordered = table.filter("block IS NULL").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    ordered.select("doc_id", "n", "ids").mapInArrow(tidied(run), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    files, place = spark._jvm.org.apache.hadoop.fs.Path(kept).getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path(kept)
    files.delete(place, True)
    sizes = blocks(spark, path).groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (s, n) -> s + n)")).alias("n"))  # a row for each file
    sizes.select("part", "n", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")).coalesce(1).write.parquet(f"{path}/parts")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def _ids_of_ranks(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.schema("rank int, id int, n long").parquet(f"{path}/ranks").collect()  # as many as the vocabulary has
    out = np.zeros(len(rows), np.uint32)
    for r in rows:
        out[r.rank] = r.id
    return out


def _documents(spark: SparkSession, path: str, found, schema: str) -> DataFrame:
    """doc_id, start, n_tokens and what found makes of a document's ids (an Arrow array of all of a block's)."""
    known = spark.sparkContext.broadcast(_ids_of_ranks(spark, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, docs, lengths, control, data = (c[i] for c in batch.columns)
                lengths = lengths.values.to_numpy().astype(np.int64)
                ends = np.cumsum(lengths)
                ids = known.value[unpacked(control.as_py(), data.as_py(), int(ends[-1]))]
                columns = [pa.array(np.full(len(ends), part.as_py(), np.int32)), docs.values, pa.array(start.as_py() + ends - lengths), pa.array(lengths)]
                yield pa.RecordBatch.from_arrays([*columns, found(ids, ends - lengths, ends)], names=["part", "doc_id", "at", "n_tokens", "found"])

    stored = blocks(spark, path).select("part", "start", "doc_ids", "lengths", "control", "data")
    read = stored.mapInArrow(tidied(run), f"part int, doc_id long, at long, n_tokens long, found {schema}")
    return read.join(spark.read.schema("part int, n long, before long").parquet(f"{path}/parts"), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "found")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (with the end id) of each document in the files; start counts the ids of all documents before it."""

    def lists(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]).astype(np.int32)), pa.array(ids.astype(np.int64)))

    return _documents(spark, path, lists, "array<bigint>").withColumnRenamed("found", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of each document in the files."""

    def sums(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        whole = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
        return pa.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())

    return _documents(spark, path, sums, "long").withColumnRenamed("found", "ids_crc32")


shipped(__name__)
