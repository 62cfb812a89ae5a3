"""The whole chain from blobs to detections, as DataFrames that share their steps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import components, detectors, layout, paint, raster, regions, report, score
from inkwell.sources import exports, images
from inkwell.sources.results import ResultStore, contents
from inkwell.sources.shared import fingerprint, kept_while, remembered, stored


@dataclass
class Analysis:
    """blobs: page_id, blob_seq, img_w, img_h, box, width, height, area. pages: page_id, img_w, img_h, for pages without blobs too."""

    blobs: DataFrame
    pages: DataFrame | None = None
    limits: regions.Limits = regions.Limits()
    detector: str = "blob"

    @cached_property
    def density(self) -> DataFrame:
        pages = self.pages if self.pages is not None else self.blobs.groupBy("page_id").agg(F.first("img_w").alias("img_w"), F.first("img_h").alias("img_h"))
        return stored(detectors.get(self.detector).detect(pages, self.blobs))

    @cached_property
    def lines(self) -> DataFrame:
        return layout.reject_reasons(self.blobs, layout.font_size(self.blobs))

    @cached_property
    def clean(self) -> DataFrame:
        kept = self.lines.filter("reject_reason IS NULL").join(self.density.select("page_id", "density_class"), "page_id")
        return components.shaped(kept, "font_size", "density_class")

    @cached_property
    def members(self) -> DataFrame:
        return stored(regions.line_members(self.clean))

    @cached_property
    def paras(self) -> DataFrame:
        return stored(regions.para_members(self.members, self.limits.para_factor))

    @cached_property
    def parts(self) -> DataFrame:
        paras = self.__dict__["paras"] if "paras" in self.__dict__ else regions.para_members(self.members, self.limits.para_factor)
        return stored(regions.split_members(paras, self.limits))  # both are windows over the same groups

    @cached_property
    def regions(self) -> DataFrame:
        return stored(regions.final_regions(self.parts, self.limits))

    @cached_property
    def rated(self) -> DataFrame:
        return stored(score.scored(score.features(self.parts, self.regions)))

    @cached_property
    def candidates(self) -> DataFrame:
        return score.candidates(self.rated)

    @cached_property
    def detections(self) -> DataFrame:
        found = score.suppress_nested(self.candidates, ["para", "part"]).drop("para", "part")
        return stored(found.join(self.density.select("page_id", "img_w", "img_h"), "page_id"))

    @cached_property
    def texts(self) -> DataFrame:
        return score.text_regions(self.regions, self.detections)

    @cached_property
    def crops(self) -> DataFrame:
        return report.crop_boxes(self.detections).join(self.detections.select("page_id", "rank", "confidence"), ["page_id", "rank"])


@dataclass
class Pages(Analysis):
    """An analysis of rasters: gray and ink rasters, and page_id, global_threshold, was_stretched of each page."""

    gray: DataFrame | None = None
    ink: DataFrame | None = None
    told: DataFrame | None = None

    @cached_property
    def crop_images(self) -> DataFrame:
        """page_id, name, png of each detection, cut from the gray page."""
        return exports.png_files(exports.crop_rasters(report.named(self.crops), self.gray)).select("page_id", "name", "png")

    @cached_property
    def page_images(self) -> DataFrame:
        """page_id, kind (gray, ink), png of each page; ink is black."""
        ink = images.mapped(self.ink, lambda page: 255 * (1 - page["pixels"].astype("int16")))
        both = self.gray.withColumn("kind", F.lit("gray")).unionByName(ink.withColumn("kind", F.lit("ink")))
        return exports.png_files(both).select("page_id", "kind", "png")

    @cached_property
    def overlay_images(self) -> DataFrame:
        """page_id, png of each gray page with its text boxes and detections painted on."""
        return exports.png_files(paint.painted(self.gray, report.overlays(self.texts, self.detections))).select("page_id", "png")

    @cached_property
    def zips(self) -> DataFrame:
        return exports.zip_files(self.crop_images)


def from_rasters(rasters: DataFrame, limits: regions.Limits = regions.Limits(), detector: str = "blob", **options) -> Pages:
    """Gray rasters through binarization and components; options as of raster.preprocess."""
    gray, ink, told = raster.preprocess(stored(rasters), **options)
    ink = stored(ink)
    sizes = ink.select("page_id", F.col("width").alias("img_w"), F.col("height").alias("img_h"))
    found = components.blobs_of_runs(components.raster_runs(ink), sizes)
    return Pages(stored(found), sizes, limits, detector, gray, ink, told)


def from_strips(strips: DataFrame, limits: regions.Limits = regions.Limits(), detector: str = "blob", **options) -> Analysis:
    """Gray pages in strips (images.strips), for pages of any size: binarized and labelled strip by strip; options as of raster.preprocess."""
    _, ink, _ = raster.preprocess(stored(strips), **options)
    ink = stored(ink)
    sizes = ink.select("page_id", F.col("width").alias("img_w"), F.col("page_height").alias("img_h")).distinct()
    return Analysis(stored(components.strip_blobs(ink)), sizes, limits, detector)


def from_pixels(gray: DataFrame, **options) -> Pages:
    """Gray pixels (page_id, r, c, gray) through binarization and components."""
    return from_rasters(images.gathered(gray), **options)


#: What a store keeps of an analysis of files: its inputs, and the steps that aren't read off others.
INPUTS = ("blobs", "pages", "gray", "ink", "told")
STEPS = ("density", "members", "paras", "parts", "regions", "rated", "detections")


def from_files(spark: SparkSession, path: str, max_dim: int | None = images.MAX_DIM, pattern: str = images.PATTERN, store: ResultStore | None = None, **options) -> Pages:
    """Image files under a path: decoded, downscaled, turned to gray and analysed.

    Results of the same files and options are kept for the session; with a store, for all sessions that share it, under a key of
    names, bytes and options. `held` of the result is then the store's lease, to be released when it is no longer read.
    """

    def run() -> Pages:
        rasters = images.to_gray(images.downscale(images.scan(spark, path, pattern), max_dim))
        return from_rasters(rasters, **options)

    told = (max_dim, pattern, repr(sorted(options.items())))
    if store is None:
        return remembered(spark, ("files", fingerprint(spark, path), *told), run)
    key = store.key(contents(spark, path, pattern), *told)
    held = store.open(key)
    if held is None:
        with kept_while(spark):
            found = run()
            held = store.publish(key, {name: getattr(found, name) for name in (*INPUTS, *STEPS)})
    known = {k: v for k, v in options.items() if k in ("limits", "detector")}
    out = Pages(**{name: held.tables[name] for name in INPUTS}, **known)
    out.__dict__.update({name: held.tables[name] for name in STEPS}, held=held)
    return out
