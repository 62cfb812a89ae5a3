"""What the operators share: shared-folder tables, Arrow slices, shipping code to executors."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass holds at a time; a longer document makes a pass of its own.
PASS_BYTES = 2 << 20


def shipped(name: str) -> None:
    """Send the module's functions to executors by value, so these need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir.

    Only where driver and executors are one process, as in tests, it may be unset; then a folder of this machine serves, until
    Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="inkwell-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = "file://" + _OWN[0]
    return f"{base.rstrip('/')}/inkwell-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has written to the shared folder; results that read them are void then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder, in a folder for each value of `by`: cuts the lineage, survives lost executors, has a known size."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes a table that `written` has made and nothing needs any more."""
    spark = table.sparkSession
    for name in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts, one at a time: rows may be large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def plain_names(*own: str):
    """For functions from a table to the same columns: all but its own go under plain names meanwhile, so whatever they are called, they clash with nothing."""

    def dressed(f: Callable[..., DataFrame]):
        @wraps(f)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            plain = [c if c in own else f"inkwell_c{i}" for i, c in enumerate(docs.columns)]
            return f(docs.toDF(*plain), *args, **options).toDF(*docs.columns)

        return run

    return dressed


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """f, giving back what memory it has freed when a partition ends: Spark keeps the worker for further tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return run


#: Rows of an Arrow batch at most: Spark's own 10,000 rows of long texts would be held several times over by each worker.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(docs: DataFrame) -> DataFrame:
    """docs, with the session's setting for batches lowered to BATCH_ROWS where it is higher."""
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, BATCH_ROWS)
    return docs


def sieve(numbers: DataFrame, per_number: int = 8, most: int = 26) -> np.ndarray:
    """A bit table that has every 64-bit number of a table of one column or more: so many bits a number, 2**most at most; where it is full, more pass than were asked for."""
    bits = min(most, max(12, (per_number * len(numbers.columns) * numbers.count()).bit_length()))
    part = max(0, bits - 20)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.sort(np.concatenate([c.to_numpy().view(np.uint64) for c in batch.columns]) >> np.uint64(64 - bits)).astype(np.int64)
            slot = slot[np.append(True, slot[1:] != slot[:-1])] if len(slot) else slot
            yield pa.RecordBatch.from_arrays([pa.array((slot >> (bits - part)).astype(np.int32)), pa.array(slot)], names=["block", "slot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            block, slot = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k in set(block.tolist()):
                tables.setdefault(k, np.zeros(1 << (bits - part), bool))[slot[block == k] & ((1 << (bits - part)) - 1)] = True
        if tables:
            yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([np.packbits(t).tobytes() for t in tables.values()], pa.binary())], names=["block", "bits"])

    dealt = numbers.mapInArrow(tidied(deal), "block int, slot long").repartition("block")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in dealt.mapInArrow(tidied(run), "block int, bits binary").collect():  # rows of 128 KB, 2**(most - 20) of them at most
        out[r.block << (bits - part - 3) : (r.block + 1) << (bits - part - 3)] = np.frombuffer(r.bits, np.uint8)
    return out


def in_sieve(table: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    slot = numbers >> np.uint64(64 - (len(table).bit_length() + 2))
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def sifted(rows: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """The rows whose 64-bit number in `column` may be among numbers (of one column): all of those that are, and few others. No row is moved."""
    table, place = rows.sparkSession.sparkContext.broadcast(sieve(numbers, 32)), rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_sieve(table.value, batch.column(place).to_numpy().view(np.uint64))))

    return small_batches(rows).mapInArrow(tidied(run), rows.schema)


def one_row_each(docs: DataFrame, digest: Column, told: DataFrame) -> DataFrame:
    """docs without the rows that told names (doc_id, digest, stays): all of those that don't stay, and all but one of those that do.

    Rows are known by doc_id, null for itself, and the digest of their text. A sieve of the rows that are named lets most
    others pass where they are; only what it holds back is moved and joined.
    """
    row, mark, key, of = (f"inkwell_{uuid.uuid4().hex}" for _ in range(4))
    named = written(told.select(F.col("doc_id").alias(key), F.col("digest").alias(of), "stays", F.xxhash64("doc_id", "digest").alias(row)).distinct())
    table = docs.sparkSession.sparkContext.broadcast(sieve(named.select(row), 32))
    marked = docs.withColumn(mark, digest).withColumn(row, F.xxhash64("doc_id", mark))
    place = len(docs.columns) + 1

    def held(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_sieve(table.value, batch.column(place).to_numpy().view(np.uint64)) == inside))

        return small_batches(marked).mapInArrow(tidied(run), marked.schema)

    asked = written(held(True))
    at = F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(of))
    kept = asked.join(named.filter("NOT stays").select(key, of), at, "left_anti")
    twins = named.filter("stays").select(key, of)
    if not twins.isEmpty():
        again = kept.join(twins, at, "left_semi").dropDuplicates(["doc_id", mark])
        kept = kept.join(twins, at, "left_anti").unionByName(again)
    return held(False).unionByName(kept).select(*(F.col(f"`{c}`") for c in docs.columns))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part holds about `limit` bytes of `column`, one row at least. Null counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = batch.set_column(at, column, text)
        sizes = pc.binary_length(text).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 1
        yield batch.slice(start)


#: A table of counts is added up in parts of this many.
TABLE_PART = 1 << 16


def tabled(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One partition's table of counts in parts (block int, counts binary)."""
    parts = [pa.compress(counts[a : a + TABLE_PART].tobytes(), codec="zstd", asbytes=True) for a in range(0, len(counts), TABLE_PART)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "counts"])


def totals(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all partitions' tables of `size` counts: added up part by part on the executors, so the driver gets `size` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = min(TABLE_PART, size - block * TABLE_PART)
                sums[block] = sums.get(block, 0) + np.frombuffer(pa.decompress(packed, decompressed_size=8 * n, codec="zstd", asbytes=True), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros(size, np.int64)
    for r in parts.repartition("block").mapInArrow(tidied(add), "block int, counts binary").collect():
        part = np.frombuffer(r.counts, np.int64)
        out[r.block * TABLE_PART : r.block * TABLE_PART + len(part)] = part
    return out


shipped(__name__)
