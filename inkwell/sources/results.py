"""Results that outlive a session: tables kept under a key of what they were made from, in a folder that sessions share."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Files:
    """Small files and folders under a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._fs = path.rstrip("/"), spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._system = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        """The file's text; None if there is none."""
        if not self._system.exists(self._at(name)):
            return None
        stream = self._system.open(self._at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Writes under another name, then renames, so that nobody sees a part. A file that is there stays where a rename doesn't replace, else the later one holds."""
        draft = f"drafts/{uuid.uuid4().hex}"
        stream = self._system.create(self._at(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._system.mkdirs(self._at(name).getParent())
        if not self._system.rename(self._at(draft), self._at(name)):
            self._system.delete(self._at(draft), False)

    def names(self, name: str) -> dict[str, float]:
        """What lies in a folder, with its time of change in seconds."""
        if not self._system.exists(self._at(name)):
            return {}
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._system.listStatus(self._at(name))}

    def size(self, name: str) -> int:
        return self._system.getContentSummary(self._at(name)).getLength()

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)


@dataclass
class Held:
    """An entry in use: its tables stay readable until release(), or until the lease runs out without renew()."""

    store: ResultStore
    data: str
    lease: str
    tables: dict[str, DataFrame]

    def renew(self) -> None:
        self.store._lease(self.data, self.lease)

    def release(self) -> None:
        self.store.files.delete(f"leases/{self.data}/{self.lease}")


class ResultStore:
    """Tables by key under `path`, which all sessions reach.

    A writer puts its tables into a folder of its own, `data/<id>`, and then publishes `entries/<key>`, a small file that names
    it; so an entry appears at once or not at all, and of several writers of one key the entry names one. A reader leaves a lease
    on the data and then looks whether the entry still names them. evict() takes entries away before it looks for leases, so
    that either the reader finds no entry or evict() finds the lease.

    A lease counts for `lease_seconds` after it was made or renewed: data of a session that died are free after that.
    """

    def __init__(self, spark: SparkSession, path: str, lease_seconds: float = 24 * 3600):
        self.spark, self.files, self.lease_seconds = spark, Files(spark, path), lease_seconds

    @staticmethod
    def key(*parts) -> str:
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    def open(self, key: str) -> Held | None:
        """The entry's tables under a lease; None if there is no such entry."""
        entry = self.files.read(f"entries/{key}")
        while entry is not None:
            known, lease = json.loads(entry), uuid.uuid4().hex
            self._lease(known["data"], lease)
            again = self.files.read(f"entries/{key}")
            if again == entry:
                self.files.write(f"used/{known['data']}/{uuid.uuid4().hex}", "")
                return Held(self, known["data"], lease, self._tables(known))
            self.files.delete(f"leases/{known['data']}/{lease}")
            entry = again
        return None

    def publish(self, key: str, tables: dict[str, DataFrame]) -> Held:
        """Writes the tables and makes them the key's entry, unless another writer was first, whose entry is then returned."""
        data, lease = uuid.uuid4().hex, uuid.uuid4().hex
        self._lease(data, lease)
        schemas = {}
        for name, table in tables.items():
            table.write.parquet(f"{self.files.path}/data/{data}/{name}")
            schemas[name] = table.schema.jsonValue()
        known = {"data": data, "bytes": self.files.size(f"data/{data}"), "schemas": schemas}
        first = self.open(key)
        if first is None:
            self.files.write(f"used/{data}/{uuid.uuid4().hex}", "")
            self.files.write(f"entries/{key}", json.dumps(known))
            first = self.open(key)
        if first is None:  # evicted meanwhile, but the lease holds the data
            return Held(self, data, lease, self._tables(known))
        for name in [f"leases/{data}/{lease}"] if first.data == data else [f"data/{data}", f"used/{data}", f"leases/{data}"]:
            self.files.delete(name)
        return first

    def evict(self, limit: int) -> list[str]:
        """Takes away the entries used longest ago until the rest have at most `limit` bytes; those under a lease stay. Returns their keys.

        Data that no entry names and no lease holds are deleted too: what eviction left to a reader, or a dead writer behind.
        """
        held = {}
        for key in self.files.names("entries"):
            entry = self.files.read(f"entries/{key}")
            if entry is not None:
                held[key] = json.loads(entry)
        total, gone = sum(e["bytes"] for e in held.values()), []
        for key in sorted(held, key=lambda k: max(self.files.names(f"used/{held[k]['data']}").values(), default=0.0)):
            if total <= limit:
                break
            if not self._leased(held[key]["data"]):
                self.files.delete(f"entries/{key}")
                total -= held[key]["bytes"]
                gone.append(key)
        named = {json.loads(e)["data"] for e in map(self.files.read, (f"entries/{k}" for k in self.files.names("entries"))) if e is not None}
        for data in self.files.names("data"):
            if data not in named and not self._leased(data):
                for name in (f"data/{data}", f"used/{data}", f"leases/{data}"):
                    self.files.delete(name)
        return gone

    def _lease(self, data: str, lease: str) -> None:
        self.files.delete(f"leases/{data}/{lease}")
        self.files.write(f"leases/{data}/{lease}", "")

    def _leased(self, data: str) -> bool:
        return any(time.time() - made < self.lease_seconds for made in self.files.names(f"leases/{data}").values())

    def _tables(self, known: dict) -> dict[str, DataFrame]:
        read = self.spark.read
        return {name: read.schema(StructType.fromJson(schema)).parquet(f"{self.files.path}/data/{known['data']}/{name}") for name, schema in known["schemas"].items()}


def contents(spark: SparkSession, path: str | list[str], pattern: str = "*") -> tuple:
    """What tells one set of files from another by names and bytes: their number and four sums over the digests of name and bytes.

    Tasks read and digest the files; one row reaches the driver, at any number of files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    digest = F.sha2(F.concat_ws(":", F.sha2("content", 256), "path"), 256)
    sums = [F.sum(F.conv(F.substring(digest, 1 + 16 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return tuple(files.agg(F.count("*"), *sums).first())


def chunked(names: DataFrame, size: int) -> Iterator[list]:
    """The rows in lists of about `size`, told apart by a hash of their first column: what the driver holds at once is bounded."""
    parts = -(-names.count() // size)
    for k in range(parts):
        rows = names.filter(F.pmod(F.xxhash64(names.columns[0]), F.lit(parts)) == k).collect()
        if rows:
            yield rows
