"""Image files analysed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.plans import analysis
from inkwell.sources import images, shared
from inkwell.sources.results import Files


def watch(
    spark: SparkSession, path: str, out: str, checkpoint: str, max_dim: int | None = images.MAX_DIM, pattern: str = images.PATTERN, once: bool = False, per_batch: int = 1000, copies: bool = True, forget: str | None = None, **options
) -> StreamingQuery:
    """Starts a query that adds the detections and densities of new files under a path to out/detections and out/density.

    At most `per_batch` names a micro-batch reach the driver; these files are then analysed like a folder and lie in a folder of the
    batch's number, which a repeated batch replaces: files count once whatever fails between. What a batch stores on the way is
    deleted when its results are written, so a long stream doesn't fill the shared folder. `once`: ends when all files there are
    done. Options as of analysis.from_rasters.

    With copies=False a file whose bytes were seen before under another name isn't analysed: tasks read and digest new files, and
    the state store keeps the digests, over restarts too. It grows with the different files, by about 100 bytes each, in the state
    store that the session names (RocksDB's needn't fit memory); `forget`, such as "30 days", drops those of files changed
    longer than that before the newest, and copies that far apart both count.
    """
    stream = spark.readStream.format("binaryFile").schema(images.BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)
    if copies:
        new = stream.select("path")
    else:
        known = stream.select("path", "modificationTime", F.sha2("content", 256).alias("digest"))
        new = (known.withWatermark("modificationTime", forget).dropDuplicatesWithinWatermark(["digest"]) if forget else known.dropDuplicates(["digest"])).select("path")

    def batch(rows: DataFrame, number: int) -> None:
        names = [r.path for r in rows.collect()]  # at most per_batch
        with shared.kept_while(spark):
            rasters = images.to_gray(images.downscale(images.scan(spark, names), max_dim)) if names else spark.createDataFrame([], images.RASTER)
            found = analysis.from_rasters(rasters, **options)
            for name, table in (("detections", found.detections), ("density", found.density)):
                table.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    writer = new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def running(spark: SparkSession, out: str, at: str, checkpoint: str, once: bool = False, per_batch: int = 1000) -> StreamingQuery:
    """Starts a query that keeps statistics of the densities that watch() writes, by density class, as a table in the folder `at`.

    density_class, pages, blobs, mean_ink, least_font, greatest_font: a stateful aggregation, so each page is read once. The state is a
    row a class. Every micro-batch writes the table anew in a folder of its number; statistics() reads the last whole one.
    """
    schema = results(spark, out, "density").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(f"{out}/density")
    stats = rows.groupBy("density_class").agg(F.count("*").alias("pages"), F.sum("total_blobs").alias("blobs"), F.avg("ink_density").alias("mean_ink"), F.min("font_size").alias("least_font"), F.max("font_size").alias("greatest_font"))

    def batch(table: DataFrame, number: int) -> None:
        table.coalesce(1).write.mode("overwrite").parquet(f"{at}/batch={number}")  # a row a class
        Files(spark, at).delete(f"batch={number - 2}")

    writer = stats.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def statistics(spark: SparkSession, at: str) -> DataFrame:
    """The table of running() as of its last micro-batch."""
    files = Files(spark, at)
    whole = [int(n[6:]) for n in files.names("") if n.startswith("batch=") and "_SUCCESS" in files.names(n)]
    if not whole:
        raise ValueError("no micro-batch has ended yet")
    return spark.read.parquet(f"{at}/batch={max(whole)}")


def results(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The rows of all batches so far: detections or density."""
    return spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}")
