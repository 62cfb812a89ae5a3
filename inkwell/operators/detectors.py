"""Density detectors by name."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout


class Detector(Protocol):
    """Gives each page of pages (page_id, img_w, img_h) a density_class and a density_confidence, from its blobs."""

    name: str

    def detect(self, pages: DataFrame, blobs: DataFrame) -> DataFrame: ...


def clamped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


class BlobDetector:
    name = "blob"

    def detect(self, pages: DataFrame, blobs: DataFrame) -> DataFrame:
        found = layout.density(pages, blobs)
        return found.withColumn("density_confidence", clamped(F.col("density_confidence"), 0.0, 1.0))


#: Names in use; the last two are older names of the first.
_NAMED: dict[str, type] = {"blob": BlobDetector, "combined": BlobDetector, "edge": BlobDetector}


def register(name: str, kind: type) -> None:
    _NAMED[name] = kind


def get(name: str = "blob") -> Detector:
    if name not in _NAMED:
        raise ValueError(f"no detector is named {name!r}; known: {', '.join(sorted(_NAMED))}")
    return _NAMED[name]()
