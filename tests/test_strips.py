"""Pages in strips give what whole pages give: blobs, histograms, blur, ink, morphology, for strips of any height."""

import numpy as np
import pytest

from inkwell.operators import components, raster
from inkwell.plans import analysis
from inkwell.sources import images

RNG = np.random.default_rng(12)


def rasters(spark, pages):
    rows = [(f"f{k}", k, *x.shape, 1, x.astype(np.uint8).tobytes()) for k, x in enumerate(pages)]
    return spark.createDataFrame(rows, images.RASTER).repartition(2)


def pixels(df):
    """Pages put together again."""
    out = {}
    for r in df.collect():
        out.setdefault(r.page_id, []).append((r["top"] if "top" in df.columns else 0, np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)))
    return {k: np.concatenate([p for _, p in sorted(v, key=lambda x: x[0])]) for k, v in out.items()}


def same(a, b):
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def spiral(n):
    """One line that winds inwards: it crosses every seam many times."""
    ink, r, c, step, turn = np.zeros((n, n)), 0, -1, n, 0
    while step > 0:
        for _ in range(step):
            r, c = r + (turn % 4 == 1) - (turn % 4 == 3), c + (turn % 4 == 0) - (turn % 4 == 2)
            ink[r, c] = 1
        turn += 1
        step -= 2 * (turn % 2) if turn > 1 else 0
        if turn == 1:
            step -= 1
    return ink


@pytest.fixture(scope="module")
def ink():
    combs = np.zeros((61, 200))
    combs[:60, ::2] = 1
    combs[60] = 1  # teeth that only the last row joins
    return [RNG.random((50, 70)) < 0.45, RNG.random((33, 20)) < 0.6, spiral(40), combs, np.ones((20, 9)), np.zeros((9, 9)), RNG.random((1, 30)) < 0.5]


@pytest.mark.parametrize("rows", [1, 2, 7, 33, 100])
def test_blobs(spark, ink, rows):
    whole = rasters(spark, ink)
    sizes = whole.select("page_id", images.F.col("width").alias("img_w"), images.F.col("height").alias("img_h"))
    want = components.blobs_of_runs(components.raster_runs(whole), sizes, 1, 1.0).collect()
    got = components.strip_blobs(images.strips(whole, rows), 1, 1.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and got.columns[0:2] == ["page_id", "blob_seq"]
    runs = components.raster_runs(images.strips(whole, rows))
    assert sorted(map(tuple, runs.collect())) == sorted(map(tuple, components.raster_runs(whole).collect()))


@pytest.mark.parametrize("rows", [5, 16, 64])
def test_stencils(spark, ink, rows):
    gray = rasters(spark, [RNG.integers(0, 256, s) for s in ((50, 70), (33, 20), (5, 5), (1, 8), (16, 3))])
    cut = images.strips(gray, rows)
    assert max(r.height for r in cut.select("height").collect()) <= rows
    same(pixels(cut), pixels(gray))
    for radius in (1, 2):
        same(pixels(raster.blurred(cut, radius)), pixels(raster.blurred(gray, radius)))
    binary = rasters(spark, ink)
    for steps in ("e", "d", "ed", "de", "eddee"):
        same(pixels(raster.morphed(images.strips(binary, rows), steps)), pixels(raster.morphed(binary, steps)))


def test_thin_strips(spark, ink):
    with pytest.raises(Exception, match="rows, but 2 are needed"):
        raster.morphed(images.strips(rasters(spark, ink), 1), "ed").count()


@pytest.mark.parametrize("options", [{}, {"noise": True, "open_": True, "close": True, "tile": 20}])
def test_preprocess(spark, options):
    pages = rasters(spark, [RNG.integers(90, 160, (100, 80)), RNG.integers(0, 256, (70, 50)), np.where(RNG.random((120, 60)) < 0.1, 20, 240)])
    want, got = raster.preprocess(pages, **options), raster.preprocess(images.strips(pages, 24), **options)
    for a, b in zip(got[:2], want[:2]):
        same(pixels(a), pixels(b))
    assert sorted(map(tuple, got[2].collect())) == sorted(map(tuple, want[2].collect()))
    one, other = analysis.from_strips(images.strips(pages, 24), **options), analysis.from_rasters(pages, **options)
    for name in ("blobs", "density", "regions", "detections", "texts"):
        assert sorted(map(str, getattr(one, name).collect())) == sorted(map(str, getattr(other, name).collect()))


def test_links_of_a_long_chain(spark):
    edges = [(p, i, i + 1) for p in (0, 1) for i in range(0, 300) if i % 100 != 99] + [(2, 5, 5)]
    got = components.linked(spark.createDataFrame(edges, "page_id int, a long, b long")).collect()
    assert {(r.page_id, r.node): r.component for r in got} == {(p, i): i // 100 * 100 for p in (0, 1) for i in range(301) if i != 300}
