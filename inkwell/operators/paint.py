"""Boxes burned into page rasters, strip by strip: filled and outlined by role, in order of z."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources import images

#: Colour, share of the fill in 256ths and width of the outline of each role.
STYLES = {
    "text": ((34, 197, 94), 31, 1),
    "standalone": ((239, 68, 68), 51, 2),
    "inline": ((59, 130, 246), 51, 2),
}
#: Boxes of a page are painted in this order.
ORDER = ("z", "y1", "x1", "y2", "x2", "role")


def painted(rasters: DataFrame, boxes: DataFrame, styles: dict[str, tuple[tuple[int, int, int], int, int]] = STYLES) -> DataFrame:
    """Rasters in RGB with the boxes (page_id, z, role, x1, y1, x2, y2; ends exclusive) on them.

    Within a box, pixels nearer to its edge than the outline is wide take the role's colour, the others a share of it, rounded down
    for each box. What lies beyond the page isn't painted, nor boxes without extent, with a null, or of a role without style.
    Each strip (images.strips) gets the boxes that touch it and nothing of its neighbours; a page that isn't cut is one strip.
    """
    cut = "strip" in rasters.columns
    keys = ["page_id", "strip"] if cut else ["page_id"]
    box = F.struct(*ORDER)
    good = boxes.filter(F.col("role").isin(*styles) & (F.col("x2") > F.greatest("x1", F.lit(0))) & (F.col("y2") > F.greatest("y1", F.lit(0)))).filter("z IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL")
    if cut:
        tall = rasters.groupBy("page_id").agg(F.max("height").alias("rows"), F.max("page_height").alias("page_height"))
        seen = good.join(tall, "page_id").filter("y1 < page_height").withColumn("strip", F.explode(F.expr("sequence(cast(greatest(y1, 0) div rows AS int), cast((least(y2, page_height) - 1) div rows AS int))")))
    else:
        seen = good
    lists = seen.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("boxes"))

    def run(row: dict) -> np.ndarray:
        pixels, top = row["pixels"], row["top"] if cut else 0
        canvas = np.repeat(pixels, 3, axis=2).astype(np.int32) if pixels.shape[2] == 1 else pixels.astype(np.int32)
        for b in row["boxes"] or ():
            colour, share, line = styles[b["role"]]
            x1, y1, x2, y2 = b["x1"], b["y1"] - top, b["x2"], b["y2"] - top
            inside = canvas[max(y1, 0) : max(y2, 0), max(x1, 0) : max(x2, 0)]
            inside[:] = (inside * (256 - share) + np.array(colour, np.int32) * share) >> 8
            for low, high, left, right in ((y1, min(y1 + line, y2), x1, x2), (max(y2 - line, y1), y2, x1, x2), (y1, y2, x1, min(x1 + line, x2)), (y1, y2, max(x2 - line, x1), x2)):
                canvas[max(low, 0) : max(high, 0), max(left, 0) : max(right, 0)] = colour
        return canvas

    return images.mapped(rasters.join(lists, keys, "left").select(*rasters.columns, "boxes"), run).drop("boxes")


def channels(rasters: DataFrame) -> DataFrame:
    """page_id, r, c, red, green, blue of RGB rasters, whole or in strips."""
    names = ("red", "green", "blue")
    flat = rasters.withColumn("width", F.col("width") * 3)
    cells = images.exploded(flat, "value", ("page_id", "top") if "top" in rasters.columns else ("page_id",))
    top = F.col("top") if "top" in rasters.columns else F.lit(0)
    picked = [F.max(F.when(F.col("c") % 3 == k, F.col("value"))).alias(n) for k, n in enumerate(names)]
    return cells.groupBy("page_id", (F.col("r") + top).alias("r"), F.expr("c div 3").cast("int").alias("c")).agg(*picked)
