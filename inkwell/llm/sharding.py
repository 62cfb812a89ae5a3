"""Sharding by size-tiered compaction over a versioned manifest.

Arrivals are appended as small immutable shards, written where they are read, without a shuffle. A tier holds the shards
whose sizes lie within one factor `fan_in` of each other; a tier with `fan_in` shards or more is merged into files of about
the target size by one job that reads its shards in order and only joins neighbouring input splits. Shards are never
changed: each step writes new files and then commits the list of those alive as the next version of the manifest.

Commit. The list is written to a folder of its own under a hidden name, then renamed to its version. A rename to a name that
is free is one atomic step of the file system; where the name is taken, file systems put the folder inside the other one
(or refuse), where readers don't see it. That holds for the file systems in ATOMIC; object stores copy instead, and a store on
one of them is refused. So a writer holds the version if, and only if, its own file then lies directly under
it. One that was too late takes the newest version and tries again; a compaction whose inputs are gone gives up its files.
A writer that dies on the way leaves a hidden folder that nobody reads. Readers see a version whole or not at all.
Superseded shards stay for readers of older versions until someone deletes them.

All work on rows is DataFrame reads and writes. Rows are kept as they are: nulls, empty and long texts, repeated rows and all
columns, whatever their names; an empty table makes no shards with rows. `read` names the shard beside a row's own columns,
under `shard` and `shard_bytes`, or where rows have such columns with underscores before. The driver knows the shards' names
and sizes, as for any table, and nothing of their rows. Equal sizes are ties that no step breaks: a tier is merged whole.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File systems whose rename is one step, by the scheme of their paths.
ATOMIC = ("file", "hdfs", "webhdfs", "viewfs", "ofs", "abfs", "abfss")
TARGET_BYTES = 64 << 20
FAN_IN = 4
SHARDS = "path string, rows long, bytes long, tier int"
MANIFEST = f"version long, {SHARDS}"


class ShardStore:
    """Shards under root/shards, versions under root/manifest."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.schema, self.target, self.fan_in = spark, root.rstrip("/"), schema, target_bytes, fan_in
        if (scheme := self._files()[0].getScheme()) not in ATOMIC:
            raise ValueError(f"{root}: a rename on {scheme} isn't one step, so versions can't be committed there")

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType, **options) -> ShardStore:
        store = cls(spark, root, schema, **options)
        if not store._commit(0, spark.createDataFrame([], SHARDS)):
            raise FileExistsError(f"{root} is a store already")
        return store

    def _files(self):
        """Hadoop's file system of the store, and its path type."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _staged(self, version: int, shards: DataFrame) -> str:
        """Writes the list of living shards under a hidden name; a row without a path marks the version itself."""
        head = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), *(F.lit(None).cast(k).alias(n) for n, k in (("path", "string"), ("rows", "long"), ("bytes", "long"), ("tier", "int"))))
        listed = shards.select(F.lit(version).cast("long").alias("version"), "path", "rows", "bytes", "tier")
        name = f"{self.root}/manifest/_staged-{uuid.uuid4().hex}"
        head.unionByName(listed).coalesce(1).write.parquet(name)
        return name

    def _publish(self, staged: str, version: int) -> bool:
        """Gives the staged list its version; False if another writer has it."""
        files, path = self._files()
        own = [f.getPath().getName() for f in files.listStatus(path(staged)) if f.getPath().getName().startswith("part-")]
        place = f"{self.root}/manifest/v={version:010d}"
        try:
            files.rename(path(staged), path(place))
        except Py4JJavaError:  # some file systems refuse instead
            pass
        if own and files.exists(path(f"{place}/{own[0]}")):
            return True
        for left in (staged, f"{place}/{staged.rsplit('/', 1)[1]}"):
            files.delete(path(left), True)
        return False

    def _commit(self, version: int, shards: DataFrame) -> bool:
        return self._publish(self._staged(version, shards), version)

    def version(self) -> int:
        files, path = self._files()
        names = [f.getPath().getName() for f in files.listStatus(path(f"{self.root}/manifest"))]
        return max(int(n[2:]) for n in names if n.startswith("v="))

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, rows, bytes, tier of each shard alive in a version, the latest if none is named."""
        version = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={version:010d}").filter("path IS NOT NULL").drop("version")

    def _tier(self) -> F.Column:
        """0 for full shards; else 1 for those above target / fan_in, 2 for those above target / fan_in**2, and so on."""
        below = F.ceil(F.log(float(self.fan_in), F.lit(float(self.target)) / F.col("bytes")))
        return F.greatest(F.lit(0), F.when(F.col("bytes") >= self.target * 3 / 4, 0).otherwise(F.greatest(F.lit(1), below))).cast("int")

    def _listed(self, run: str, deep: bool = False) -> DataFrame:
        """The files of a run with their rows and sizes."""
        read = self.spark.read.schema(self.schema).option("recursiveFileLookup", str(deep).lower()).parquet(run)
        meta = read.metadataColumn("_metadata")
        files = read.select(meta["file_path"].alias("path"), meta["file_size"].alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        return files.withColumn("tier", self._tier()).select("path", "rows", "bytes", "tier")

    def _add(self, shards: DataFrame) -> int:
        """The next free version, with these shards beside those alive."""
        while True:
            version = self.version()
            if self._commit(version + 1, self.manifest(version).unionByName(shards)):
                return version + 1

    def append(self, rows: DataFrame) -> int:
        """The rows as new shards; returns the version that has them."""
        run = f"{self.root}/shards/{uuid.uuid4().hex}"
        rows.select(*self._own(rows)).write.parquet(run)
        return self._add(self._listed(run))

    def _own(self, rows: DataFrame) -> list[F.Column]:
        return [rows[f"`{name}`"] for name in self.schema.names]

    def append_arrivals(self, rows: DataFrame, arrival: F.Column, n: int) -> int:
        """Arrivals 0 to n-1 that stand in one table: all are written in one pass, then committed one after the other. Rows with another arrival, or none, are committed last, together; returns the latest version."""
        run, key = f"{self.root}/shards/{uuid.uuid4().hex}", "arrival_" + uuid.uuid4().hex
        own = F.coalesce(F.when(arrival.between(0, n - 1), arrival.cast("int")), F.lit(n))
        rows.select(*self._own(rows), own.alias(key)).write.partitionBy(key).parquet(run)
        listed = self._listed(run, deep=True).collect()
        version = self.version()
        for k in range(n + 1):
            mine = [r for r in listed if f"{key}={k}/" in r.path]
            if mine or k < n:
                version = self._add(self.spark.createDataFrame(mine, SHARDS))
        return version

    def compact(self) -> int:
        """Merges each tier of small shards that has `fan_in` or more, smallest first; returns the latest version."""
        while True:
            version = self.version()
            alive = self.manifest(version)
            tiers = alive.filter("tier > 0").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).filter(F.col("n") >= self.fan_in)
            due = tiers.orderBy(F.desc("tier")).first()
            if due is None:
                return version
            paths = [r.path for r in alive.filter(F.col("tier") == due.tier).orderBy("path").collect()]
            run = f"{self.root}/shards/{uuid.uuid4().hex}"
            files = max(1, round(due.bytes / self.target))
            self.spark.read.schema(self.schema).parquet(*paths).coalesce(files).write.parquet(run)
            self._replace(paths, self._listed(run))

    def _replace(self, paths: list[str], merged: DataFrame) -> bool:
        """Puts merged shards in the place of those at paths; False if some of these are gone by now."""
        names = self.spark.createDataFrame([(p,) for p in paths], "path string")
        while True:
            version = self.version()
            alive = self.manifest(version)
            if alive.join(names, "path", "left_semi").count() < len(paths):
                return False
            if self._commit(version + 1, alive.join(names, "path", "left_anti").unionByName(merged)):
                return True

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with shard (file name) and shard_bytes beside their own columns."""
        paths = [r.path for r in self.manifest(version).orderBy("path").collect()]
        shard, size = self._free("shard"), self._free("shard_bytes")
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(shard, T.StringType()), T.StructField(size, T.LongType())]))
        read = self.spark.read.schema(self.schema).parquet(*paths)
        meta = read.metadataColumn("_metadata")
        return read.select("*", meta["file_name"].alias(shard), meta["file_size"].alias(size))

    def _free(self, name: str) -> str:
        taken = {n.lower() for n in self.schema.names}
        while name in taken:
            name = "_" + name
        return name
