"""The results of a folder of image files, brought up to date file by file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from inkwell.plans import analysis
from inkwell.sources import images, shared
from inkwell.sources.results import Files, chunked

#: Pages with the file they are of, and the results of an analysis.
TABLES = ("pages", "told", "density", "regions", "detections", "texts")
MANIFEST = "path string, encoded string, length long, modified timestamp, gone boolean"
PAGES = "page_id long, file string, img_w int, img_h int"


class Collection:
    """Results of the image files under `path`, in tables under `out`.

    refresh() lists the files, finds those that are new, changed (length or time) or gone since the last time, and analyses the new
    and changed ones alone. Their rows go into a new generation, beside a part of the manifest: path, length, modified and
    whether the file is gone. A file's rows count where its newest generation is, so nothing is rewritten. A generation counts
    from the moment its commit, a small file, is there; what a stopped refresh left without one is written anew. compact() brings
    all that counts together in one generation.

    One refresh or compact at a time; readers need no care, but tables read before a compact() end with its delete=True.
    Unchanged length and time of change count as an unchanged file. Options as of analysis.from_rasters; they are part of the
    commits, and other options than those before are refused.
    """

    def __init__(self, spark: SparkSession, path: str, out: str, max_dim: int | None = images.MAX_DIM, pattern: str = images.PATTERN, per_generation: int = 10000, **options):
        self.spark, self.path, self.files = spark, path, Files(spark, out)
        self.max_dim, self.pattern, self.per_generation, self.options = max_dim, pattern, per_generation, options
        self._told = repr((max_dim, pattern, sorted(options.items())))

    def refresh(self) -> dict[str, int]:
        """Counts of files: analysed, gone, kept."""
        with shared.kept_while(self.spark):
            listed = self.spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).load(self.path)
            now = shared.stored(listed.select("path", F.col("_metadata.file_path").alias("encoded"), "length", F.col("modificationTime").alias("modified")))
            known = self.manifest()
            same = [F.col(f"n.{c}") == F.col(f"k.{c}") for c in ("path", "length", "modified")]
            changed = shared.stored(now.alias("n").join(known.alias("k"), same, "left_anti"))
            gone = shared.stored(known.join(now, "path", "left_anti").select("path", "encoded", "length", "modified"))
            counts = {"analysed": changed.count(), "gone": gone.count()}
            counts["kept"] = now.count() - counts["analysed"]
            for rows in chunked(changed, self.per_generation):
                with shared.kept_while(self.spark):
                    self._add(self.spark.createDataFrame(rows, changed.schema), [r.path for r in rows])
            if counts["gone"]:
                self._commit(self._free(), gone.withColumn("gone", F.lit(True)), {})
        return counts

    def manifest(self) -> DataFrame:
        """path, encoded, length, modified, generation of each file that counts."""
        rows = self._read("manifest", StructType.fromDDL(MANIFEST))
        last = rows.groupBy("path").agg(F.max_by(F.struct("encoded", "length", "modified", "gone", "generation"), "generation").alias("last"))
        return last.filter("NOT last.gone").select("path", *(f"last.{c}" for c in ("encoded", "length", "modified", "generation")))

    def table(self, name: str) -> DataFrame:
        """One of TABLES, of all files as of the last refresh."""
        pages = self._live()
        if name == "pages":
            return pages.drop("generation")
        schemas = self._schemas()
        if not schemas:
            raise ValueError("nothing has been analysed yet")
        return self._read(name, StructType.fromJson(schemas[name])).join(pages.select("page_id", "generation"), ["page_id", "generation"], "left_semi").drop("generation")

    def compact(self, delete: bool = True) -> None:
        """Brings what counts together in one generation; the earlier ones are deleted on demand."""
        old, new = self._generations(), self._free()
        tables = {name: self.table(name) for name in TABLES} if self._schemas() else {}
        self._commit(new, self.manifest().drop("generation").withColumn("gone", F.lit(False)), tables, base=True)
        for g in old if delete else ():
            self.files.delete(f"commits/{g}")
            for name in ("manifest", *TABLES):
                self.files.delete(f"{name}/generation={g}")

    def _add(self, files: DataFrame, paths: list[str]) -> None:
        rasters = images.to_gray(images.downscale(images.scan(self.spark, paths), self.max_dim))
        found = analysis.from_rasters(rasters, **self.options)
        file = F.coalesce(F.nullif(F.regexp_extract("origin", r"(?i)^(.*\.tiff?)#\d+$", 1), F.lit("")), "origin")
        tables = {name: getattr(found, name) for name in TABLES if name != "pages"}
        pages = found.gray.select("page_id", file.alias("file"), F.col("width").alias("img_w"), F.col("height").alias("img_h"))
        self._commit(self._free(), files.withColumn("gone", F.lit(False)), {"pages": pages, **tables})

    def _commit(self, generation: int, manifest: DataFrame, tables: dict[str, DataFrame], base: bool = False) -> None:
        for name, table in {"manifest": manifest, **tables}.items():
            table.write.mode("overwrite").parquet(f"{self.files.path}/{name}/generation={generation}")
        schemas = {name: table.schema.jsonValue() for name, table in tables.items()}
        self.files.write(f"commits/{generation}", json.dumps({"told": self._told, "base": base, "schemas": schemas}))

    def _schemas(self) -> dict:
        """Of the tables; empty if nothing has been analysed."""
        return next(filter(None, (json.loads(self.files.read(f"commits/{g}"))["schemas"] for g in reversed(self._generations()))), {})

    def _free(self) -> int:
        return max(map(int, self.files.names("commits")), default=0) + 1

    def _generations(self) -> list[int]:
        """Committed ones, from the last compact on."""
        found = sorted(map(int, self.files.names("commits")))
        for i in range(len(found) - 1, -1, -1):
            commit = json.loads(self.files.read(f"commits/{found[i]}"))
            if commit["told"] != self._told:
                raise ValueError(f"{self.files.path} holds results of other options: {commit['told']}")
            if commit["base"]:
                return found[i:]
        return found

    def _read(self, name: str, schema: StructType) -> DataFrame:
        fields = StructType([*schema.fields, StructField("generation", IntegerType())])
        paths = [f"{self.files.path}/{name}/generation={g}" for g in self._generations() if self.files.names(f"{name}/generation={g}")]
        if not paths:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).option("basePath", f"{self.files.path}/{name}").parquet(*paths)

    def _live(self) -> DataFrame:
        """Pages of the files that count; a file is known by its name, plain or encoded, as readers tell it."""
        names = self.manifest().select(F.explode(F.array_distinct(F.array("path", "encoded"))).alias("file"), "generation")
        return self._read("pages", StructType.fromDDL(PAGES)).join(names, ["file", "generation"])
