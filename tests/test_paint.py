"""Painted boxes against a painter that goes pixel by pixel."""

import numpy as np
import pytest

from inkwell.operators import paint
from inkwell.plans import analysis
from inkwell.sources import exports, images

from .test_files import page

BOXES = "page_id int, z int, role string, x1 int, y1 int, x2 int, y2 int"


def brute(gray, boxes):
    out = np.repeat(gray[:, :, None], 3, axis=2).astype(int)
    for z, y1, x1, y2, x2, role in sorted((z, y1, x1, y2, x2, role) for p, z, role, x1, y1, x2, y2 in boxes if p == 1 and role in paint.STYLES and None not in (z, x1, y1, x2, y2)):
        colour, share, line = paint.STYLES[role]
        for r in range(max(y1, 0), min(y2, len(gray))):
            for c in range(max(x1, 0), min(x2, gray.shape[1])):
                near = min(r - y1, y2 - 1 - r, c - x1, x2 - 1 - c) < line
                out[r, c] = colour if near else [(int(v) * (256 - share) + k * share) // 256 for v, k in zip(out[r, c], colour, strict=True)]
    return out


@pytest.mark.parametrize("rows", [0, 1, 7, 100])
def test_painted(spark, rows):
    rng = np.random.default_rng(rows)
    gray = rng.integers(0, 256, (37, 29)).astype(np.uint8)
    boxes = [(1, int(rng.integers(0, 3)), role, x, y, x + int(rng.integers(-1, 20)), y + int(rng.integers(-1, 25))) for role in [*paint.STYLES, "other"] for x, y in rng.integers(-8, 40, (12, 2)).tolist()]
    boxes += [boxes[0], (1, 0, None, 0, 0, 9, 9), (1, None, "text", 0, 0, 9, 9), (1, 0, "text", None, 0, 9, 9), (1, 0, "text", 0, 0, 9, None), (7, 0, "text", 0, 0, 9, 9)]
    rasters = spark.createDataFrame([("a", 1, 37, 29, 1, gray.tobytes()), ("b", 2, 2, 2, 3, bytes(range(12)))], images.RASTER.replace("page_id long", "page_id int"))
    got = paint.painted(images.strips(rasters, rows) if rows else rasters, spark.createDataFrame(boxes, BOXES))
    parts = sorted(((r.page_id, r["top"] if rows else 0, r.data) for r in got.collect()), key=lambda x: x[:2])
    joined = {p: b"".join(d for q, _, d in parts if p == q) for p in (1, 2)}
    assert (np.frombuffer(joined[1], np.uint8).reshape(37, 29, 3) == brute(gray, boxes)).all() and joined[2] == bytes(range(12))
    cells = {(r.r, r.c): (r.red, r.green, r.blue) for r in paint.channels(got.filter("page_id = 1")).collect()}
    assert len(cells) == 37 * 29 and cells[36, 28] == tuple(brute(gray, boxes)[36, 28])


def test_no_rows(spark):
    none = spark.createDataFrame([], images.RASTER)
    boxes = spark.createDataFrame([], BOXES)
    assert paint.painted(none, boxes).count() == 0 and paint.painted(images.strips(none, 4), boxes).count() == 0


def test_overlay_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(exports.png(page().tobytes(), 320))
    found = analysis.from_files(spark, f"file://{tmp_path}")
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "o.png").write_bytes(found.overlay_images.first().png)
    got = images.scan(spark, f"file://{tmp_path}/out").first()
    assert (got.width, got.height, got.channels) == (320, 240, 3)
    box = found.texts.first()
    assert tuple(np.frombuffer(got.data, np.uint8).reshape(240, 320, 3)[box.y1, box.x1]) == paint.STYLES["text"][0]
