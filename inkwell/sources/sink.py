"""Files written by tasks and shown by a commit: a file's bytes come in parts, in order, so that no task holds it whole."""

from __future__ import annotations

import csv
import io
import sys
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import together

#: About how many bytes of a file are one part.
PART = 1 << 22


@dataclass
class Written(WriterCommitMessage):
    """One task's files: their names, and the folder in which they wait."""

    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    """Rows (name, part, data) that come file by file, in order of their parts.

    Each attempt of a task writes into a folder of its own under `_drafts`, which readers pass over. The commit moves the
    files of the attempts that count to their places, which copies no bytes on a file system; then it writes _SUCCESS. A
    job that fails or is stopped before its commit shows no file.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._open()
        folder, names, out = f"{root}/_drafts/{self.job}/{uuid.uuid4().hex}", [], None
        try:
            for row in iterator:
                if not names or names[-1] != row.name:
                    if out:
                        out.close()
                    if not row.name or "/" in row.name or row.name[0] in "._":
                        raise ValueError(f"no name of a file: {row.name!r}")
                    store.create_dir(folder)
                    out = store.open_output_stream(f"{folder}/{row.name}")
                    names.append(row.name)
                out.write(row.data or b"")
        finally:
            if out:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._open()
        moves = [(f"{m.folder}/{n}", f"{root}/{n}") for m in messages if m for n in m.names]
        if len({to for _, to in moves}) < len(moves):
            raise ValueError("a file's parts came to several tasks")
        there = [to for _, to in moves if not self.overwrite and store.get_file_info(to).type != fs.FileType.NotFound]
        if there:
            raise FileExistsError(there[0])
        store.create_dir(root)
        for draft, to in moves:
            store.move(draft, to)
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = self._open()
        if store.get_file_info(f"{root}/_drafts/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/_drafts/{self.job}")


class FilesSink(DataSource):
    """spark.dataSource.register(FilesSink), then write.format("inkwell_files") with a path, mode append."""

    @classmethod
    def name(cls) -> str:
        return "inkwell_files"

    def schema(self) -> str:
        return "name string, part struct<task: long, seq: long>, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options.get("replace", "false") == "true")


def write_parts(parts: DataFrame, path: str, overwrite: bool = False) -> None:
    """Files of parts (name, part: task and seq, data) in a folder, each the bytes of its parts in their order.

    A file's parts go through one task, sorted by Spark, which spills; different files through different tasks. Files that are
    there are an error before any is moved, unless they may be overwritten. Any path that pyarrow opens: file, hdfs, s3, gs.
    """
    parts.sparkSession.dataSource.register(FilesSink)
    ordered = parts.select("name", "part", "data").repartition("name").sortWithinPartitions("name", "part")
    ordered.write.format("inkwell_files").option("path", path).option("replace", str(overwrite).lower()).mode("append").save()


def csv_parts(rows: DataFrame, name: str) -> DataFrame:
    """One CSV file with a header as parts: rows are turned to text by all tasks, in order of partitions. Nulls are empty."""
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(rows.columns)
    text = rows.select(*(F.col(f"`{c.replace('`', '``')}`").cast("string").alias(f"c{i}") for i, c in enumerate(rows.columns)), F.spark_partition_id().cast("long").alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, batch in enumerate(b for b in batches if b.num_rows):
            held = io.StringIO()
            *columns, task = (c.to_pylist() for c in batch.columns)
            csv.writer(held, lineterminator="\n").writerows(zip(*columns, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([task[0]], pa.int64()), pa.array([seq], pa.int64()), pa.array([held.getvalue().encode()], pa.binary())], names=["task", "seq", "data"])

    body = text.mapInArrow(run, "task long, seq long, data binary")
    first = rows.sparkSession.createDataFrame([(-1, 0, header.getvalue().encode())], "task long, seq long, data binary")
    return first.unionByName(body).select(F.lit(name).alias("name"), F.struct("task", "seq").alias("part"), "data")


class _Stream(io.RawIOBase):
    """What is written, until it is taken."""

    def __init__(self):
        super().__init__()
        self.held = bytearray()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.held += data
        return len(data)

    def take(self) -> bytes:
        out, self.held = bytes(self.held), bytearray()
        return out


def zip_parts(named: DataFrame) -> DataFrame:
    """A ZIP file a page, `<page_id>.zip`, of its files (page_id, name, png) in order of names, as parts.

    A page's files stream through one task, sorted by Spark: it holds one of them, a part and the directory. Archives of more than
    65,535 files or 4 GB are ZIP64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, seq, stream, archive = None, 0, _Stream(), None

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{page}.zip"]), pa.array([0], pa.int64()), pa.array([seq], pa.int64()), pa.array([stream.take()], pa.binary())], names=["file", "task", "seq", "data"])

        for batch in batches:
            for i in range(batch.num_rows):
                own, name, data = (c[i].as_py() for c in batch.columns)
                if archive is None or own != page:
                    if archive is not None:
                        archive.close()
                        yield part()
                    page, seq, archive = own, 0, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
                if len(stream.held) >= PART:
                    yield part()
                    seq += 1
        if archive is not None:
            archive.close()
            yield part()

    ordered = named.select("page_id", "name", "png").transform(together, "page_id").sortWithinPartitions("page_id", "name")
    out = ordered.mapInArrow(run, "file string, task long, seq long, data binary")
    return out.select(F.col("file").alias("name"), F.struct("task", "seq").alias("part"), "data")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed
