"""Pages made from the generic tables: rasters from embeddings, laid-out blobs and boxes from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, r, c, gray: a page for each label, a row of pixels for each of its embeddings."""
    rows = _table(spark, sf_dir, "embeddings").withColumn("r", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    pixels = rows.select(F.col("label").cast("int").alias("page_id"), "r", F.posexplode("embedding").alias("c", "e"))
    value = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("e").cast("double") + 0.5) * 255.0))).cast("int")
    return pixels.select("page_id", "r", "c", value.alias("gray"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("gray")
    return gray(spark, sf_dir).select("page_id", "r", "c", g.alias("red"), ((g * 7 + F.col("c")) % 256).alias("green"), ((g * 13 + F.col("r")) % 256).alias("blue"))


def low_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray(spark, sf_dir).withColumn("gray", F.expr("cast(80 + gray div 4 as int)"))


def ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray(spark, sf_dir).select("page_id", "r", "c", (F.col("gray") < 105).cast("int").alias("ink"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, blob_seq, img_w, img_h, x1, y1, x2, y2, width, height, area: pages of text lines, equations, rules and frames."""
    b = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS ck", "o_orderkey div 300 AS page_id", "(o_orderkey div 300) % 3 AS pk", "(o_orderkey % 300) div 20 AS line", "o_orderkey % 20 AS slot")
    b = b.withColumn("eq", F.expr("line % 5 = 1")).filter("(NOT eq AND (pk <> 0 OR slot < 8)) OR (eq AND (pk = 2 OR slot BETWEEN 3 AND 9))")
    b = b.withColumn("h", F.expr("CASE WHEN k % 97 = 0 OR k % 151 = 0 THEN 260 WHEN NOT eq THEN 18 + ck % 3 ELSE element_at(array(8, 12, 20, 38, 50, 3), cast(ck % 6 AS int) + 1) END"))
    b = b.withColumn("w", F.expr("CASE WHEN k % 97 = 0 THEN 3 WHEN k % 151 = 0 THEN 16 WHEN eq THEN if(ck % 6 = 5, 90, 10 + ck % 9) ELSE element_at(array(14, 20, 28), cast(pk AS int) + 1) + ck % 6 END"))
    b = b.withColumn("x1", F.expr("CASE WHEN k % 97 <> 0 AND k % 151 = 0 THEN 2 ELSE if(eq AND pk <> 2, 250, 40) + slot * 34 + ck % 5 END"))
    b = b.withColumn("y1", F.expr("if(pk = 2, 12 + line * 23, 60 + line * 60) + if(eq, ck % 17, ck % 3)"))
    ints = ["800 AS img_w", "if(pk = 2, 354, 1000) AS img_h", "x1", "y1", "x1 + w - 1 AS x2", "y1 + h - 1 AS y2", "w AS width", "h AS height", "(w * h * (if(pk = 0, 15, 40) + ck % 50)) div 100 AS area"]
    out = b.selectExpr("cast(page_id AS int) AS page_id", "k AS blob_seq", *ints)
    return out.select("page_id", "blob_seq", *(F.col(c).cast("int").alias(c) for c in out.columns[2:]))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, det_seq, x1, y1, x2, y2: heavily overlapping boxes."""
    made = ["o_orderkey div 300 AS page_id", "o_orderkey % 300 AS det_seq", "o_custkey % 200 AS x1", "(o_orderkey * 37) % 300 AS y1", "o_custkey % 200 + 20 + o_custkey % 120 AS x2", "(o_orderkey * 37) % 300 + 15 + o_orderkey % 60 AS y2"]
    out = _table(spark, sf_dir, "orders").selectExpr(*made)
    return out.select(*(F.col(c).cast("int").alias(c) for c in out.columns))
