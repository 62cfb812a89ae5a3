"""Crops, overlays, histograms and summaries of analysed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.operators import ranks
from inkwell.sources import exports
from inkwell.sources.images import exploded, gathered

PADDING = 10


def crop_boxes(detections: DataFrame, padding: int = PADDING) -> DataFrame:
    """Detections (page_id, rank, box, img_w, img_h) in reading order with index and padded, clamped crop box (ends exclusive)."""
    index = F.row_number().over(W.partitionBy("page_id").orderBy("y1", "rank"))
    edge = {"cx1": F.greatest(F.lit(0), F.col("x1") - padding), "cy1": F.greatest(F.lit(0), F.col("y1") - padding), "cx2": F.least("img_w", F.col("x2") + padding), "cy2": F.least("img_h", F.col("y2") + padding)}
    return detections.select("page_id", "rank", index.alias("index"), "x1", "y1", "x2", "y2", *(e.alias(n) for n, e in edge.items()))


def crop_pixels(crops: DataFrame, pixels: DataFrame) -> DataFrame:
    """page_id, index, r, c, gray of the pixels in each crop; a crop without extent is one white pixel."""
    cut = exports.crop_rasters(crops.select("page_id", "index", "cx1", "cy1", "cx2", "cy2"), gathered(pixels))
    return exploded(cut, "gray", ("page_id", "index"))


def named(crops: DataFrame) -> DataFrame:
    """crops with the name of each one's file."""
    return crops.withColumn("name", F.format_string("eq_%03d_conf%.2f.png", "index", "confidence"))


def crop_names(crops: DataFrame) -> DataFrame:
    return named(crops).select("page_id", "index", "name")


def describe(rows: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, p25, p50, p75, max of a numeric column, rounded; the quartiles are exact and found in bounded memory when this is called."""
    v = F.col(value)
    quartiles = zip(("p25", "p50", "p75"), ranks.percentiles(rows, value, (0.25, 0.5, 0.75)), strict=True)
    found = {"mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), **{n: F.lit(q).cast("double") for n, q in quartiles}, "max": F.max(v)}
    return rows.agg(F.count(v).alias("count"), *(F.round(e, 3).alias(n) for n, e in found.items()))


def percentiles(rows: DataFrame, value: str, *shares: float) -> DataFrame:
    """share, value of exact percentiles, for as many values as there may be."""
    found = zip(shares, ranks.percentiles(rows, value, shares), strict=True)
    return rows.sparkSession.createDataFrame(list(found), "share double, value double")


def histogram(rows: DataFrame, value: str, bins: int, *keys: str) -> DataFrame:
    """keys, bin (from 0), n over equal bins between the least and the greatest value; the last bin is closed."""
    edges = rows.groupBy(*keys).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    flat = F.col("hi") == F.col("lo")
    lo, hi = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
    known = rows.filter(F.col(value).isNotNull())
    joined = known.join(edges, list(keys)) if keys else known.crossJoin(F.broadcast(edges))  # a single row
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / ((hi - lo) / bins)).cast("int"))
    return joined.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def height_marks(blobs: DataFrame, fonts: DataFrame, tall: float = 1.9, tiny: float = 0.42) -> DataFrame:
    """page_id, font_size, tall_px, tiny_px, total, tall_count, tiny_count: the marks of the histogram of heights."""
    h, fs = F.col("height"), F.col("font_size")
    out = blobs.join(fonts, "page_id").groupBy("page_id", "font_size")
    return out.agg((F.first("font_size") * tall).alias("tall_px"), (F.first("font_size") * tiny).alias("tiny_px"), F.count("*").alias("total"), F.count_if(h > fs * tall).alias("tall_count"), F.count_if(h < fs * tiny).alias("tiny_count"))


def threshold_counts(rows: DataFrame, value: str, cut: float) -> DataFrame:
    above = F.count_if(F.col(value) >= cut)
    return rows.agg(above.alias("above"), F.count_if(F.col(value) < cut).alias("below"), F.round(above * 100.0 / F.count(value), 3).alias("above_pct"))


def outlier(height: Column, width: Column, fs: Column, tall: float = 1.9) -> Column:
    return (height > fs * tall) | ((width > fs * 4) & (height < fs * 0.5))


def blob_map(blobs: DataFrame) -> DataFrame:
    """page_id, outlier, n for blobs with font_size."""
    return blobs.groupBy("page_id", outlier(F.col("height"), F.col("width"), F.col("font_size")).alias("outlier")).agg(F.count("*").alias("n"))


def overlays(texts: DataFrame, detections: DataFrame) -> DataFrame:
    """Boxes to draw: page_id, z, role, box, confidence; text below, detections above."""
    box = ["x1", "y1", "x2", "y2"]
    below = texts.select("page_id", F.lit(0).alias("z"), F.lit("text").alias("role"), *box, F.lit(None).cast("double").alias("confidence"))
    role = F.when(F.col("class") == 0, "standalone").otherwise("inline")
    return below.unionByName(detections.select("page_id", (F.col("class") + 1).alias("z"), role.alias("role"), *box, "confidence"))


def gallery(crops: DataFrame, columns: int = 3) -> DataFrame:
    i = F.col("index") - 1
    return crops.select("page_id", "index", F.floor(i / columns).cast("int").alias("grid_row"), (i % columns).alias("grid_col"))


def report_rows(detections: DataFrame) -> DataFrame:
    return detections.select("page_id", "x1", "y1", "x2", "y2", "confidence", (F.col("x2") - F.col("x1")).alias("width_px"), (F.col("y2") - F.col("y1")).alias("height_px"))


def page_summary(density: DataFrame, texts: DataFrame, detections: DataFrame) -> DataFrame:
    """page_id, equations, text_regions, density_class, font_size of every page."""
    count = lambda df, name: df.groupBy("page_id").agg(F.count("*").alias(name))
    out = density.join(count(detections, "equations"), "page_id", "left").join(count(texts, "text_regions"), "page_id", "left")
    return out.select("page_id", F.coalesce("equations", F.lit(0)).alias("equations"), F.coalesce("text_regions", F.lit(0)).alias("text_regions"), "density_class", "font_size")
