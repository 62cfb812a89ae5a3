"""Pixels gathered in strips equal pages cut to strips; no task is given more than batches of pixels."""

import numpy as np
import pytest

from inkwell.operators import raster
from inkwell.sources import images


def pixels(spark):
    rng = np.random.default_rng(3)
    rows = [(page, r, c, int(rng.integers(0, 256)), int(rng.integers(0, 256))) for page, h, w in ((-4, 30, 7), (0, 1, 1), (3, 16, 300), (9, 9, 5)) for r in range(h) for c in range(w)]
    rows += [(11, 2, 3, 7, 8), (11, 29, 1, 9, 10), (11, 29, 0, 1, 2)]  # most of its places, and strips, have no pixel
    rng.shuffle(rows)
    return spark.createDataFrame([tuple(map(int, r)) for r in rows], "page_id int, r int, c int, a int, b int").repartition(5)


@pytest.mark.parametrize("rows", [8, 3, 100])
def test_strips(spark, rows):
    found = pixels(spark)
    order = ["page_id", "top"]
    got = images.gathered(found, ("a", "b"), rows)
    want = images.strips(images.gathered(found, ("a", "b")), rows).select(got.columns)
    assert [tuple(r) for r in got.orderBy(*order).collect()] == [tuple(r) for r in want.orderBy(*order).collect()]
    whole = {r.page_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels) for r in images.gathered(found, ("a", "b")).collect()}
    assert whole[11].shape == (30, 4, 2) and whole[11].sum() == 37
    assert all(whole[p][r, c].tolist() == [a, b] for p, r, c, a, b in found.collect())
    spread = images.exploded(images.gathered(found, "a", rows))
    assert sorted(map(tuple, spread.filter("page_id < 11").collect())) == sorted(map(tuple, found.filter("page_id < 11").select("page_id", "r", "c", "a").collect()))
    assert images.gathered(found.filter("page_id > 50"), "a", rows).count() == 0


def test_in_batches(spark):
    """A raster that comes in many batches grows both ways."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = pixels(spark).select("page_id", "r", "c", "a").filter("page_id < 11")
        for rows in (None, 8):
            assert sorted(map(tuple, images.exploded(images.gathered(found, "a", rows)).collect())) == sorted(map(tuple, found.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_page_is_collected(spark):
    plan = raster.dilate(pixels(spark).selectExpr("page_id", "r", "c", "a % 2 AS ink"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
