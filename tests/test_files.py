"""Image files to detections and back to files, on pages drawn here."""

import io
import math
import struct
import zipfile
import zlib

import numpy as np
import pytest

from inkwell.operators import detectors, raster, regions
from inkwell.plans import analysis
from inkwell.sources import exports, images, shared
from inkwell.streaming import pages


def rgba(pixels: np.ndarray) -> bytes:
    """A PNG of four channels."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, w * 4 + 1), np.uint8)
    rows[:, 1:] = pixels.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def page(height=240, width=320) -> np.ndarray:
    """Lines of boxes for letters, some white around."""
    gray = np.full((height, width), 245, np.uint8)
    for top in range(30, height - 30, 24):
        for left in range(24, width - 30, 16):
            gray[top : top + 12, left : left + 9] = 20
    return gray


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pages")
    rng = np.random.default_rng(4)
    colours = rng.integers(0, 256, (7, 5, 3), np.uint8)
    see = rng.integers(0, 256, (6, 4, 4), np.uint8)
    (at / "gray.png").write_bytes(exports.png(page().tobytes(), 320))
    (at / "rgb.png").write_bytes(exports.png(colours.tobytes(), 5, 3))
    (at / "rgba.png").write_bytes(rgba(see))
    (at / "broken.png").write_bytes(b"no image")
    (at / "notes.txt").write_text("no image")
    return at, colours, see


def named(rasters):
    return {r.origin.rsplit("/", 1)[1]: r for r in rasters.collect()}


def test_scan(spark, folder):
    at, colours, see = folder
    got = named(images.scan(spark, f"file://{at}"))
    assert set(got) == {"gray.png", "rgb.png", "rgba.png"} and got["gray.png"].data == page().tobytes()
    assert got["rgb.png"].data == colours.tobytes()
    alpha, want = see[:, :, 3:].astype(float), see[:, :, :3].astype(float)
    laid = np.frombuffer(got["rgba.png"].data, np.uint8).reshape(6, 4, 3)
    assert np.abs(laid - (want * alpha + 255 * (255 - alpha)) / 255).max() <= 0.51
    assert len(named(images.scan(spark, f"file://{at}", keep_invalid=True))) == 4
    assert len({r.page_id for r in got.values()}) == 3


def test_luma_and_downscale(spark, folder):
    at, colours, _ = folder
    rasters = images.scan(spark, f"file://{at}")
    gray = named(images.to_gray(rasters))
    want = [[int(0.299 * r + 0.587 * g + 0.114 * b) for r, g, b in row] for row in colours.astype(int).tolist()]
    assert np.frombuffer(gray["rgb.png"].data, np.uint8).reshape(7, 5).tolist() == want
    small = named(images.downscale(rasters, 100))
    assert (small["gray.png"].width, small["gray.png"].height) == (100, 75) and small["rgb.png"].data == colours.tobytes()
    assert named(images.downscale(rasters, None))["gray.png"].width == 320


def lanczos(n: int, size: int) -> np.ndarray:
    """Weights place by place, as the definition has them."""
    scale = max(n / size, 1.0)
    out = np.zeros((size, n))
    for x in range(size):
        centre = (x + 0.5) * n / size
        for i in range(max(0, int(centre - 3 * scale + 0.5)), min(n, int(centre + 3 * scale + 0.5))):
            t = (i + 0.5 - centre) / scale
            out[x, i] = 0.0 if abs(t) >= 3 else (1.0 if t == 0 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("shape", [(40, 30, 20, 17), (9, 50, 3, 11), (5, 5, 1, 1)])
def test_resampled(shape):
    h, w, height, width = shape
    x = np.random.default_rng(1).integers(0, 256, (h, w, 1), np.uint8)
    across = np.clip(np.floor(x[:, :, 0] @ lanczos(w, width).T + 0.5), 0, 255)
    down = np.clip(np.floor(lanczos(h, height) @ across + 0.5), 0, 255)
    assert np.abs(images.resampled(x, height, width)[:, :, 0] - down).max() <= 1


def test_rasters_and_pixels(spark):
    """Rasters give what tables of pixels give."""
    rng = np.random.default_rng(7)
    x = rng.integers(90, 160, (70, 50)).astype(np.uint8)
    pixels = spark.createDataFrame([(3, r, c, int(v)) for (r, c), v in np.ndenumerate(x)], "page_id int, r int, c int, gray int")
    rasters = images.gathered(pixels)
    assert rasters.first().data == x.tobytes() and sorted(images.exploded(rasters).collect()) == sorted(pixels.collect())
    counts = raster.tile_counts(rasters)
    assert sorted(map(tuple, raster._tiles(counts).collect())) == sorted(map(tuple, raster.otsu_tiles(pixels).collect()))
    spread = raster.stretched(rasters, raster._page_counts(counts))
    assert spread.first().was_stretched and sorted(images.exploded(spread).collect()) == sorted(raster.stretch(pixels).select("page_id", "r", "c", "gray").collect())
    gray, ink, told = raster.preprocess(rasters, noise=True, open_=True, close=True, tile=20)
    assert told.first().was_stretched and set(np.frombuffer(ink.first().data, np.uint8)) <= {0, 1}
    soft = images.gathered(raster.blur(raster.stretch(pixels), 2)).first()
    assert soft.data == gray.first().data


def test_files_to_results(spark, folder, tmp_path):
    at, _, _ = folder
    found = analysis.from_files(spark, f"file://{at}", pattern="gray.png")
    assert found.blobs.count() == 8 * 17 and {(r.width, r.height) for r in found.blobs.select("width", "height").collect()} == {(9, 12)}
    assert found.density.count() == 1 and found.told.first().was_stretched is False
    assert analysis.from_files(spark, f"file://{at}", pattern="gray.png") is found
    assert analysis.from_files(spark, f"file://{at}", pattern="gray.png", tile=64) is not found
    boxes = spark.createDataFrame([(1, 10, 20, 60, 50), (2, 5, 5, 5, 9)], "rank int, x1 int, y1 int, x2 int, y2 int").crossJoin(found.gray.select("page_id"))
    crops = boxes.selectExpr("page_id", "rank AS index", "x1 AS cx1", "y1 AS cy1", "x2 AS cx2", "y2 AS cy2", "'eq_' || rank || '.png' AS name")
    cut = {r["index"]: r for r in exports.crop_rasters(crops, found.gray).collect()}
    assert cut[1].data == page()[20:50, 10:60].tobytes() and (cut[2].width, cut[2].height, cut[2].data) == (1, 1, b"\xff")
    archive = zipfile.ZipFile(io.BytesIO(exports.zip_files(exports.png_files(exports.crop_rasters(crops, found.gray))).first().zip))
    assert archive.namelist() == ["eq_1.png", "eq_2.png"]
    (tmp_path / "png").mkdir()
    for name in archive.namelist():
        (tmp_path / "png" / name).write_bytes(archive.read(name))
    again = named(images.scan(spark, f"file://{tmp_path}/png"))
    assert again["eq_1.png"].data == page()[20:50, 10:60].tobytes()
    exports.write_csv(boxes.drop("page_id"), f"file://{tmp_path}/csv", single=True)
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/csv").columns == ["rank", "x1", "y1", "x2", "y2"]
    assert found.crop_images.columns == ["page_id", "name", "png"] and found.zips.columns == ["page_id", "zip"]


def test_page_images(spark, folder, tmp_path):
    found = analysis.from_files(spark, f"file://{folder[0]}", pattern="gray.png")
    for r in found.page_images.collect():
        (tmp_path / f"{r.kind}.png").write_bytes(r.png)
    got = named(images.scan(spark, f"file://{tmp_path}"))
    assert got["gray.png"].data == page().tobytes()
    assert (np.frombuffer(got["ink.png"].data, np.uint8) == np.where(page().ravel() < 128, 0, 255)).all()


def test_stream(spark, tmp_path):
    """Two runs over a folder that grows: each file counts once."""
    at, out, state = (f"file://{tmp_path}/{n}" for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.png").write_bytes(exports.png(page(120 + 24 * k).tobytes(), 320))
        if k != 1:
            pages.watch(spark, at, out, state, once=True, per_batch=2).awaitTermination()
    density = pages.results(spark, out, "density").collect()
    assert len(density) == 3 and len({r.page_id for r in density}) == 3 and sorted({r.batch for r in density}) == [0, 1]
    want = analysis.from_files(spark, at).density.select("page_id", "total_blobs", "density_class").collect()
    assert sorted(want) == sorted((r.page_id, r.total_blobs, r.density_class) for r in density)
    assert pages.results(spark, out, "detections").columns[:2] == ["page_id", "rank"]


def test_pages_without_ink(spark, tmp_path):
    (tmp_path / "white.png").write_bytes(exports.png(bytes([255]) * 64 * 64, 64))
    found = analysis.from_files(spark, f"file://{tmp_path}")
    assert found.density.first().total_blobs == 0 and found.detections.count() == 0 and found.zips.count() == 0


def test_limits(spark):
    blobs = [(0, i, 500, 500, 20 + 15 * (i % 10), 20 + 200 * (i // 10), 30 + 15 * (i % 10), 31 + 200 * (i // 10), 11, 12, 100) for i in range(11)]
    table = spark.createDataFrame(blobs, "page_id int, blob_seq long, img_w int, img_h int, x1 int, y1 int, x2 int, y2 int, width int, height int, area int")
    count = lambda **k: analysis.Analysis(table, limits=regions.Limits(**k)).regions.count()
    assert (count(), count(min_blobs=2), count(para_factor=50), count(min_density=0.99)) == (2, 1, 1, 0)
    assert count(max_aspect=1.0, para_factor=0.5) == 2


def test_detectors(spark):
    assert detectors.get("edge").name == "blob"
    with pytest.raises(ValueError, match="nothing"):
        detectors.get("nothing")
    row = spark.range(1).select(detectors.clamped(detectors.F.lit(1.5), 0.0, 1.0).alias("x")).first()
    assert row.x == 1.0


def test_release(spark):
    kept = shared.stored(spark.range(3))
    assert kept.count() == 3
    shared.release(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(kept.inputFiles()[0])


def test_csv_over_a_folder(spark, tmp_path):
    at = f"file://{tmp_path}/csv"
    exports.write_csv(spark.range(3), at)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        exports.write_csv(spark.range(5), at)
    exports.write_csv(spark.range(5), at, overwrite=True)
    assert spark.read.option("header", "true").csv(at).count() == 5
