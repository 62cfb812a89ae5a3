"""Pixel operators.

Statistics (histograms, percentiles, Otsu thresholds) are aggregations over (page_id, gray, n) tables, counted from pixels or
from rasters. What moves pixels (blur, thresholds by place, morphology) works on rasters, one row a page, without a shuffle;
for tables of pixels (page_id, r, c, value) these gather a page's pixels once, in strips, and spread the result again.

Wherever rasters are taken, pages may come in strips (images.strips) as well, with the same result: histograms are added up,
and what looks around a pixel gets the rows around its strip from the strips beside it. So no task holds more than a strip.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.sources.images import STRIP, exploded, gathered, mapped, stenciled
from inkwell.sources.shared import stored

LOW_CONTRAST = 120
#: Luma weights of BT.601.
LUMA = (0.299, 0.587, 0.114)
INK_BIAS = 5
DARK, DARK_SHARE = 128, 0.03


def luma(pixels: DataFrame) -> DataFrame:
    r, g, b = LUMA
    value = (F.lit(r) * F.col("red") + F.lit(g) * F.col("green") + F.lit(b) * F.col("blue")).cast("int")
    return pixels.select("page_id", "r", "c", value.alias("gray"))


def _spread(counted: DataFrame, *keys: str) -> DataFrame:
    """Of keys, gray, n: also over the lower values below_n, below_sum; in all total, total_sum."""
    upto = W.partitionBy(*keys).orderBy("gray").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    mass = F.col("n") * F.col("gray")
    return counted.select("*", F.sum("n").over(upto).alias("below_n"), F.sum(mass).over(upto).alias("below_sum"), F.sum("n").over(whole).alias("total"), F.sum(mass).over(whole).alias("total_sum"))


def counted(pixels: DataFrame, *keys: str) -> DataFrame:
    """keys, gray, n of pixels."""
    return pixels.groupBy(*keys, "gray").agg(F.count("*").alias("n"))


def _edge(rasters: DataFrame, tile: int | None) -> Column:
    return F.lit(tile) if tile is not None else tile_size(F.col("page_height" if "strip" in rasters.columns else "height"))


def _top(rasters: DataFrame) -> Column:
    """The first row's place in the page."""
    return F.col("top") if "strip" in rasters.columns else F.lit(0).alias("top")


def tile_counts(rasters: DataFrame, tile: int | None = None) -> DataFrame:
    """page_id, tr, tc, gray, n of gray rasters: at most 256 rows a tile, however many pixels it has."""
    page = rasters.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                gray = np.frombuffer(row["data"], np.uint8).astype(np.int64).reshape(row["height"], row["width"])
                across = -(-row["width"] // row["edge"])
                of = ((row["top"] + np.arange(row["height"])) // row["edge"] * across)[:, None] + np.arange(row["width"]) // row["edge"]
                counts = np.bincount(((of << 8) | gray).ravel())
                at = np.flatnonzero(counts)
                of, gray = at >> 8, at & 255
                yield pa.RecordBatch.from_arrays([pa.array([row["page_id"]] * len(at), batch.schema.field("page_id").type), *(pa.array(x.astype(np.int32)) for x in (of // across, of % across, gray)), pa.array(counts[at])], names=["page_id", "tr", "tc", "gray", "n"])

    found = rasters.filter("height > 0").select("page_id", "height", "width", _edge(rasters, tile).alias("edge"), _top(rasters), "data").mapInArrow(run, f"page_id {page}, tr int, tc int, gray int, n long")
    return found.groupBy("page_id", "tr", "tc", "gray").agg(F.sum("n").alias("n")) if "strip" in rasters.columns else found


def _page_counts(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("page_id", "gray").agg(F.sum("n").alias("n"))


def _limits(counts: DataFrame) -> DataFrame:
    reach = lambda p: F.min(F.when(F.col("below_n") > F.floor(F.lit(p) * F.col("total")), F.col("gray")))
    found = _spread(counts, "page_id").groupBy("page_id").agg(reach(0.02).alias("lo"), reach(0.98).alias("hi"))
    return found.withColumn("low_contrast", F.col("hi") - F.col("lo") < LOW_CONTRAST)


def contrast_limits(pixels: DataFrame) -> DataFrame:
    """page_id, lo, hi (nearest-rank 2nd and 98th percentile), low_contrast."""
    return _limits(counted(pixels, "page_id"))


def stretch(pixels: DataFrame) -> DataFrame:
    """Pages of low contrast spread over 0 to 255; the others as they are."""
    span = F.col("hi") - F.col("lo")
    spread = F.greatest(F.lit(0), F.least(F.lit(255), ((F.col("gray") - F.col("lo")) * (F.lit(255.0) / span)).cast("int")))
    value = F.when(F.col("low_contrast") & (span != 0), spread).otherwise(F.col("gray"))
    return pixels.join(contrast_limits(pixels), "page_id").select("page_id", "r", "c", value.alias("gray"))


def stretched(rasters: DataFrame, counts: DataFrame) -> DataFrame:
    """Gray rasters, spread where contrast is low, with was_stretched; counts: page_id, gray, n of each page."""

    def spread(page: dict) -> np.ndarray:
        lo, hi = page["lo"], page["hi"]
        if not page["was_stretched"] or hi == lo:
            return page["pixels"]
        return np.clip(((np.arange(256) - lo) * (255.0 / (hi - lo))).astype(np.int64), 0, 255)[page["pixels"]]

    limits = _limits(counts).select("page_id", F.col("low_contrast").alias("was_stretched"), "lo", "hi")
    return mapped(rasters.join(limits, "page_id"), spread).drop("lo", "hi")


def kernel(radius: int) -> list[float]:
    sigma = max(radius / 2, 0.5)
    weights = [math.exp(-(k * k) / (2 * sigma**2)) for k in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def _convolved(values: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    """Weighted sum along an axis; places outside take the edge's value."""
    radius, n = len(weights) // 2, values.shape[axis]
    moved = [np.take(values, np.clip(np.arange(n) + k - radius, 0, n - 1), axis) * w for k, w in enumerate(weights)]
    return sum(moved[1:], moved[0])


def blurred(rasters: DataFrame, radius: Column | int, most: int = 2) -> DataFrame:
    """Gray rasters through a separable Gaussian, rounded half to even; the radius may differ by page, then it is at most `most`."""

    def soft(page: dict) -> np.ndarray:
        if not page["blur_radius"]:
            return page["pixels"]
        weights = kernel(page["blur_radius"])
        return np.rint(_convolved(_convolved(page["pixels"].astype(np.float64), weights, 1), weights, 0))

    fixed = not isinstance(radius, Column)
    return stenciled(rasters.withColumn("blur_radius", F.lit(radius) if fixed else radius), soft, radius if fixed else most).drop("blur_radius")


def blur(pixels: DataFrame, radius: int) -> DataFrame:
    """Separable Gaussian, rounded half to even."""
    return exploded(blurred(gathered(pixels, rows=STRIP), radius)) if radius else pixels.select("page_id", "r", "c", "gray")


def _otsu(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, threshold of keys, gray, n: the first value that splits with the greatest variance between the sides, 0 if none does."""
    above = F.col("total") - F.col("below_n")
    gap = F.col("below_sum") / F.col("below_n") - (F.col("total_sum") - F.col("below_sum")) / above
    spread = F.when(above > 0, (F.col("below_n") * above).cast("double") * (gap * gap)).otherwise(0.0)
    judged = _spread(counts, *keys).withColumn("spread", spread)
    best = F.max(F.struct("spread", (-F.col("gray")).alias("down")))
    dark = F.sum(F.when(F.col("gray") < DARK, F.col("n")).otherwise(0)) / F.max("total")
    return judged.groupBy(*keys).agg(best.alias("best"), dark.alias("dark_share")).select(*keys, F.when(F.col("best.spread") > 0, -F.col("best.down")).otherwise(0).cast("int").alias("threshold"), "dark_share")


def otsu_global(pixels: DataFrame) -> DataFrame:
    """page_id, threshold, cut: ink is below the cut."""
    return _cut(counted(pixels, "page_id"))


def _cut(counts: DataFrame) -> DataFrame:
    return _otsu(counts, "page_id").select("page_id", "threshold", (F.col("threshold") - INK_BIAS).alias("cut"))


def otsu_binarize(pixels: DataFrame) -> DataFrame:
    """page_id, r, c, ink: below the page's own cut."""
    return pixels.join(otsu_global(pixels), "page_id").select("page_id", "r", "c", (F.col("gray") < F.col("cut")).cast("int").alias("ink"))


def tile_size(height: Column) -> Column:
    return F.greatest(F.lit(32), F.least(F.lit(128), (height / F.lit(74.0) * 3).cast("int")))


def page_sizes(pixels: DataFrame) -> DataFrame:
    """page_id, height, width, tile (edge length of its tiles)."""
    sizes = pixels.groupBy("page_id").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"))
    return sizes.withColumn("tile", tile_size(F.col("height")))


def otsu_tiles(pixels: DataFrame) -> DataFrame:
    """page_id, tr, tc, threshold of each tile; nearly white tiles don't exceed the page's threshold."""
    tiled = pixels.join(page_sizes(pixels), "page_id").selectExpr("page_id", "gray", "cast(r div tile AS int) AS tr", "cast(c div tile AS int) AS tc")
    return _tiles(counted(tiled, "page_id", "tr", "tc"))


def _tiles(counts: DataFrame) -> DataFrame:
    page = _otsu(_page_counts(counts), "page_id").select("page_id", F.col("threshold").alias("page_threshold"))
    found = _otsu(counts, "page_id", "tr", "tc").join(page, "page_id")
    held = F.when(F.col("dark_share") < DARK_SHARE, F.least("threshold", "page_threshold")).otherwise(F.col("threshold"))
    return found.select("page_id", "tr", "tc", held.alias("threshold"))


def binarized(rasters: DataFrame, tile: int | None = None) -> DataFrame:
    """Gray rasters as ink (0 or 1): below the threshold that tiles give when interpolated, or extrapolated towards the edges."""
    tiles = _tiles(tile_counts(rasters, tile))
    grid = tiles.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("tr", "tc", "threshold"))).alias("grid"))

    def ink(page: dict) -> np.ndarray:
        cells, gray = page["grid"], page["pixels"][:, :, 0]
        last = cells[-1]["tr"], cells[-1]["tc"]
        cuts = np.array([c["threshold"] for c in cells], np.int64).reshape(last[0] + 1, last[1] + 1)

        def place(n: int, most: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = (start + np.arange(n) + 0.5) / page["edge"] - 0.5
            low = np.maximum(0, np.minimum(most - 1, np.floor(t).astype(np.int64)))
            return low, np.minimum(low + 1, most), t - low

        r0, r1, dr = place(gray.shape[0], last[0], page.get("top", 0))
        c0, c1, dc = place(gray.shape[1], last[1], 0)
        dr, at = dr[:, None], lambda r, c: cuts[r[:, None], c]
        cut = at(r0, c0) * (1 - dr) * (1 - dc) + at(r0, c1) * (1 - dr) * dc + at(r1, c0) * dr * (1 - dc) + at(r1, c1) * dr * dc
        return (gray < cut + INK_BIAS)[:, :, None]

    return mapped(rasters.join(grid, "page_id").withColumn("edge", _edge(rasters, tile)), ink).drop("grid", "edge")


def adaptive_binarize(pixels: DataFrame) -> DataFrame:
    """page_id, r, c, ink: below the threshold that tiles give when interpolated, or extrapolated towards the edges."""
    return exploded(binarized(stored(gathered(pixels, rows=STRIP))), "ink")


def _eroded(ink: np.ndarray, least: int) -> np.ndarray:
    """Ink where at least `least` of the nine places around have it; the outermost places stay blank."""
    out = np.zeros_like(ink)
    if min(ink.shape) > 2:
        h, w = ink.shape
        near = sum(ink[i : h - 2 + i, j : w - 2 + j] for i in range(3) for j in range(3))
        out[1:-1, 1:-1] = near >= least
    return out


def morphed(rasters: DataFrame, steps: str) -> DataFrame:
    """Ink rasters eroded (e) and dilated (d), one after the other, in one pass."""

    def run(page: dict) -> np.ndarray:
        ink = page["pixels"][:, :, 0]
        for step in steps:
            ink = _eroded(ink, 9 if step == "e" else 1)
        return ink[:, :, None]

    return stenciled(rasters, run, len(steps)) if steps else rasters


def erode(pixels: DataFrame) -> DataFrame:
    return exploded(morphed(gathered(pixels, "ink", STRIP), "e"), "ink")


def dilate(pixels: DataFrame) -> DataFrame:
    """As erode, leaves the outermost pixels blank."""
    return exploded(morphed(gathered(pixels, "ink", STRIP), "d"), "ink")


def opening(pixels: DataFrame) -> DataFrame:
    return exploded(morphed(gathered(pixels, "ink", STRIP), "ed"), "ink")


def closing(pixels: DataFrame) -> DataFrame:
    return exploded(morphed(gathered(pixels, "ink", STRIP), "de"), "ink")


def preprocess(rasters: DataFrame, noise: bool = False, open_: bool = False, close: bool = False, tile: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Gray rasters to ink: stretched where contrast is low, blurred if noisy (more after a stretch), binarized, opened and closed if asked.

    Returns gray rasters as binarized, ink rasters, and page_id, global_threshold, was_stretched.
    """
    gray = stretched(rasters, _page_counts(tile_counts(rasters, tile)))
    if noise:
        gray = blurred(gray, F.when(F.col("was_stretched"), 2).otherwise(1))
    gray = stored(gray)  # its histogram, its ink and crops all read it
    told = gray.select("page_id", "was_stretched").distinct().join(_otsu(_page_counts(tile_counts(gray, tile)), "page_id").select("page_id", F.col("threshold").alias("global_threshold")), "page_id")
    gray = gray.drop("was_stretched")
    ink = morphed(binarized(gray, tile), ("ed" if open_ else "") + ("de" if close else ""))
    return gray, ink, told.select("page_id", "global_threshold", "was_stretched")


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed
