"""From blobs to the page's body size, its density, and the blobs that are no rules or frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_FONT = 20
#: Fixed values: (sparse below, dense from) of each signal.
CUTS = {"ink_density": (0.025, 0.055), "body_ratio": (0.45, 0.65), "blobs_per_line": (12.0, 25.0)}
LABELS = ("SPARSE", "MEDIUM", "DENSE")


def font_size(blobs: DataFrame) -> DataFrame:
    """page_id, font_size: the commonest height, of blobs above specks if there are any; of equal ones the first met."""
    plain = ((F.col("area") > 10) & (F.col("height") > 4)).cast("int")
    counted = blobs.groupBy("page_id", plain.alias("plain"), "height").agg(F.count("*").alias("n"), F.min("blob_seq").alias("first"))
    all_of = counted.groupBy("page_id", "height").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.lit(0).alias("plain"))
    both = counted.filter("plain = 1").select("page_id", "plain", "height", "n", "first").unionByName(all_of)
    best = W.partitionBy("page_id").orderBy(F.desc("plain"), F.desc("n"), "first")
    return both.withColumn("turn", F.row_number().over(best)).filter("turn = 1").select("page_id", F.col("height").alias("font_size"))


def _vote(name: str) -> Column:
    low, high = CUTS[name]
    return F.when(F.col(name) < low, -1).when(F.col(name) >= high, 1).otherwise(0)


def density(pages: DataFrame, blobs: DataFrame) -> DataFrame:
    """Signals, votes, density_class and density_confidence of each page of pages (page_id, img_w, img_h); one without blobs is sparse for certain."""
    fs = F.col("font_size")
    sized = blobs.join(font_size(blobs), "page_id")
    body = F.count_if((F.col("height") >= fs * 0.60) & (F.col("height") <= fs * 1.40))
    found = sized.groupBy("page_id", "font_size").agg(F.count("*").alias("total_blobs"), F.sum("area").alias("ink"), body.alias("body"))
    out = pages.select("page_id", "img_w", "img_h").join(found, "page_id", "left").withColumn("font_size", F.coalesce("font_size", F.lit(DEFAULT_FONT)))
    out = out.withColumn("total_blobs", F.coalesce("total_blobs", F.lit(0)))
    out = out.withColumn("ink_density", F.col("ink") / (F.col("img_w") * F.col("img_h"))).withColumn("body_ratio", F.col("body") / F.col("total_blobs"))
    out = out.withColumn("estimated_lines", F.greatest(F.lit(1.0), F.col("img_h") / (fs * 1.5))).withColumn("blobs_per_line", F.col("total_blobs") / F.col("estimated_lines"))
    out = out.withColumns({f"vote_{n}": _vote(c) for n, c in (("ink", "ink_density"), ("body", "body_ratio"), ("bpl", "blobs_per_line"))})
    total = F.col("vote_ink") + F.col("vote_body") + F.col("vote_bpl")
    empty, v = F.col("total_blobs") == 0, F.col("vote_sum")
    out = out.withColumn("vote_sum", total)
    kind = F.when(empty, 0).when(v == 3, 2).when(v <= -1, 0).otherwise(1)
    sure = F.when(empty, 1.0).when(F.abs(v) == 3, 0.90).when(v >= 1, 0.65).when(v <= -1, 0.70).otherwise(0.60)
    return out.drop("ink", "body").withColumn("density_class", kind).withColumn("density_confidence", sure)


def labelled(found: DataFrame) -> DataFrame:
    """With density_label, doc_type and is_sparse, is_medium, is_dense."""
    name = F.element_at(F.array(*map(F.lit, LABELS)), F.col("density_class") + 1)
    flags = {f"is_{n.lower()}": F.col("density_class") == k for k, n in enumerate(LABELS)}
    return found.withColumns({"density_label": name, "doc_type": F.when(F.col("density_class") == 2, "dense").otherwise("sparse"), **flags})


def reject_reasons(blobs: DataFrame, fonts: DataFrame, thin: float = 0.6, span: float = 0.10, frame_span: float = 0.15, margin: int = 12) -> DataFrame:
    """blobs with font_size and reject_reason: horizontal_line, vertical_line, frame_stroke or null."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    most, iw, ih = F.col("font_size") * thin, F.col("img_w"), F.col("img_h")
    across = (w >= h) & (h <= most) & (w >= iw * span) & (w / F.greatest(h, F.lit(1)) >= 6)
    down = (h >= w) & (w <= most) & (h >= ih * span) & (h / F.greatest(w, F.lit(1)) >= 6)
    frame = ((F.col("y1") <= margin) | (F.col("y2") >= ih - margin)) & (w >= iw * frame_span)
    frame |= ((F.col("x1") <= margin) | (F.col("x2") >= iw - margin)) & (h >= ih * frame_span)
    return blobs.join(fonts, "page_id").withColumn("reject_reason", F.when(across, "horizontal_line").when(down, "vertical_line").when(frame, "frame_stroke"))
