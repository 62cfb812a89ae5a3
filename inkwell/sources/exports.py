"""Results as files: CSV of detections, PNG of rasters, ZIP of a page's crops."""

from __future__ import annotations

import io
import struct
import sys
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def png(data: bytes, width: int, channels: int = 1) -> bytes:
    """A PNG file of gray (1 channel) or RGB (3) pixels, rows without filter."""
    pixels = np.frombuffer(data, np.uint8).reshape(-1, width * channels)
    rows = np.zeros((pixels.shape[0], width * channels + 1), np.uint8)
    rows[:, 1:] = pixels

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, pixels.shape[0], 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def png_files(rasters: DataFrame) -> DataFrame:
    """The rasters (width, channels, data, and any columns) with `png` in the place of their pixels."""
    kept = [c for c in rasters.columns if c not in ("width", "channels", "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data, width, channels = (row.column(c)[0].as_py() for c in ("data", "width", "channels"))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in kept), pa.array([png(data, width, channels)], pa.binary())], names=[*kept, "png"])

    schema = rasters.select(*kept).schema.add("png", "binary")
    return rasters.mapInArrow(run, schema)


def crop_rasters(crops: DataFrame, rasters: DataFrame) -> DataFrame:
    """The crops (page_id, index, cx1, cy1, cx2, cy2, and any columns) with height, width, channels, data cut from their page.

    Each page meets its own crops once, as a list; a crop without extent is one white pixel.
    """
    boxes = crops.groupBy("page_id").agg(F.collect_list(F.struct(*(c for c in crops.columns if c != "page_id"))).alias("boxes"))
    paged = rasters.select("page_id", "height", "width", "channels", "data").join(boxes, "page_id").select("page_id", "height", "width", "channels", "data", "boxes")
    kept = [c for c in crops.columns if c != "page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                pixels = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])
                for box in row["boxes"]:
                    cut = pixels[max(box["cy1"], 0) : max(box["cy2"], 0), max(box["cx1"], 0) : max(box["cx2"], 0)]
                    if not cut.size:
                        cut = np.full((1, 1, row["channels"]), 255, np.uint8)
                    yield pa.RecordBatch.from_pylist([{**box, "page_id": row["page_id"], "height": cut.shape[0], "width": cut.shape[1], "channels": row["channels"], "data": cut.tobytes()}], out)

    fields = ", ".join(f"`{c}` {crops.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"page_id {rasters.schema['page_id'].dataType.simpleString()}, {fields}, height int, width int, channels int, data binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return paged.mapInArrow(run, schema)


def zip_files(named: DataFrame) -> DataFrame:
    """page_id, zip of the files (page_id, name, png) of each page, deflated, in order of their names. A page's crops are one row."""
    files = named.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("name", "png"))).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                    for f in row.column("files")[0].as_py():
                        archive.writestr(zipfile.ZipInfo(f["name"]), f["png"], zipfile.ZIP_DEFLATED)
                yield pa.RecordBatch.from_arrays([row.column("page_id"), pa.array([held.getvalue()], pa.binary())], names=["page_id", "zip"])

    return files.mapInArrow(run, f"page_id {named.schema['page_id'].dataType.simpleString()}, zip binary")


def write_csv(rows: DataFrame, path: str, single: bool = False, overwrite: bool = False) -> None:
    """CSV with a header in a folder; `single`: as one file, for results that one task can write. A folder that is there is an error, unless it may be overwritten."""
    (rows.coalesce(1) if single else rows).write.mode("overwrite" if overwrite else "errorifexists").option("header", "true").csv(path)


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package installed
