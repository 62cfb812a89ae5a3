"""Nested boxes by pairs and rounds, near boxes by cells, against brute force; plans without nested loops."""

import time

import numpy as np
import pytest

from inkwell.operators import regions, score

BOX = "page_id int, seq int, x1 int, y1 int, x2 int, y2 int, note string"


def greedy(rows, share=0.7):
    kept = {}
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    for r in sorted(rows, key=lambda r: (-area(r), r[1])):
        mine = kept.setdefault(r[0], [])
        over = lambda k: (min(k[4], r[4]) - max(k[2], r[2]), min(k[5], r[5]) - max(k[3], r[3]))  # noqa: E731, B023
        if not any(w > 0 and h > 0 and area(r) > 0 and w * h / area(r) >= share for w, h in map(over, mine)):
            mine.append(r)
    return sorted((r[0], i + 1, *r[1:]) for mine in kept.values() for i, r in enumerate(mine))


def boxes(seed, n, spread):
    rng = np.random.default_rng(seed)
    x, y, w, h = (rng.integers(0, m, n) for m in (spread, spread, spread // 2, spread // 2))
    rows = [(int(k % 3), k, int(a - spread // 4), int(b), int(a - spread // 4 + c), int(b + d), "n") for k, (a, b, c, d) in enumerate(zip(x, y, w, h))]
    chain = [(7, k, 3 * k, 0, 3 * k + 10, 10, "c") for k in range(60)]  # each in the one before, but for the rest
    return rows + chain + [(8, k, 5, 5, 9, 9, "same") for k in range(5)] + [(8, 9, 6, 6, 6, 9, "flat")]


@pytest.mark.parametrize(("seed", "spread", "most"), [(1, 60, 0), (2, 400, 0), (3, 60, 40), (4, 60, 100000)])
def test_rounds(spark, seed, spread, most):
    rows = boxes(seed, 240, spread)
    table = spark.createDataFrame(rows, BOX).repartition(3)
    for share in (0.7, 0.55):
        want = greedy(rows, share)
        assert sorted(map(tuple, score.by_pairs(table, ["seq"], share, most).collect())) == want
    assert sorted(map(tuple, score.by_fold(table, ["seq"], 0.55).collect())) == want
    assert score.by_pairs(spark.createDataFrame([], BOX), ["seq"]).count() == 0 == score.suppress_nested(spark.createDataFrame([], BOX), ["seq"]).count()


def test_pairs_once(spark):
    rows = boxes(5, 150, 50)
    table = spark.createDataFrame(rows, BOX).withColumn("less", score._less()).withColumn("turn", score.F.col("seq").cast("long"))
    got = [tuple(r) for r in score.nested_pairs(table, 0.7).collect()]
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    over = lambda a, b: (min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3]))
    want = [(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and area(b) > 0 and min(over(a, b)) > 0 and over(a, b)[0] * over(a, b)[1] / area(b) >= 0.7]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_large_page(spark):
    """200,000 boxes of one page, within a minute."""
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 20000, (2, 200000))
    w, h = rng.integers(20, 120, (2, 200000))
    import pandas as pd

    table = spark.createDataFrame(pd.DataFrame({"page_id": 0, "seq": np.arange(200000), "x1": x, "y1": y, "x2": x + w, "y2": y + h}))
    began = time.time()
    kept = score.suppress_nested(table, ["seq"]).toPandas()
    assert time.time() - began < 60 and 100000 < len(kept) < 200000
    assert sorted(kept["rank"]) == list(range(1, len(kept) + 1))
    near = kept[(kept.x1 < 900) & (kept.y1 < 900)]  # those that stay don't hold each other
    area = ((near.x2 - near.x1) * (near.y2 - near.y1)).to_numpy()
    a, b = near.to_numpy()[:, None], near.to_numpy()[None]
    names = list(near.columns)
    c = lambda t, n: t[..., names.index(n)]
    over = np.maximum(0, np.minimum(c(a, "x2"), c(b, "x2")) - np.maximum(c(a, "x1"), c(b, "x1"))) * np.maximum(0, np.minimum(c(a, "y2"), c(b, "y2")) - np.maximum(c(a, "y1"), c(b, "y1")))
    np.fill_diagonal(over, 0)
    assert (over < 0.7 * np.minimum(area[:, None], area[None])).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_near_boxes(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for page in range(2):
        made = sorted((int(rng.integers(0, 300)), int(rng.integers(-20, 200)), int(rng.integers(0, 60)), int(rng.integers(0, 40))) for _ in range(120))
        rows += [(page, i, x, y, x + w, y + h, 4.5 * page, 7.25) for i, (y, x, w, h) in enumerate(made)]
    rows += [(5, 1, 0, 0, 3000, 2, 1.0, 0.0), (5, 2, 2999, 1, 4000, 5, 1.0, 0.0), (5, 3, 3000, 3, 3000, 3, 1.0, 0.0)]
    table = spark.createDataFrame(rows, "page_id int, rank int, x1 int, y1 int, x2 int, y2 int, v_gap double, h_gap double")
    edges = regions.proximity_edges(table)
    want = [(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and b[3] - a[5] <= a[6] and max(a[2], b[2]) - min(a[4], b[4]) <= a[7]]
    assert sorted(map(tuple, edges.collect())) == sorted(want)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("seed", "spread", "most", "turns"), [(6, 60, 60, 256), (8, 60, 100000, 2)])
def test_tiles(spark, seed, spread, most, turns, monkeypatch):
    """Boxes that meet across tiles, few at a time, and chains longer than a task's rounds."""
    rows = boxes(seed, 300, spread) + [(9, 0, -5000, -5000, 5000, 5000, "frame"), (9, 1, -4999, -4999, 4999, 0, "half"), (9, 2, 40, 40, 48, 48, "dot")]
    table = spark.createDataFrame(rows, BOX).repartition(3)
    monkeypatch.setattr(score, "STEP", 50)
    monkeypatch.setattr(score, "ROUNDS", turns)
    assert sorted(map(tuple, score.by_pairs(table, ["seq"], most=most).collect())) == greedy(rows)


def test_rounds_send_few_pairs(spark, monkeypatch):
    """What boxes of a tile settle among themselves isn't sent as pairs."""
    rows = [(p, k, 3 * (k % 40), 5 * (k // 40), 3 * (k % 40) + 40, 5 * (k // 40) + 60, "n") for p in range(4) for k in range(240)]
    table, sent = spark.createDataFrame(rows, BOX), []
    keep = score.stored
    monkeypatch.setattr(score, "stored", lambda df: sent.append(keep(df)) or sent[-1])
    assert sorted(map(tuple, score.by_pairs(table, ["seq"], most=100).collect())) == greedy(rows)
    turned = sent[0].select("page_id", "turn", "less", "x1", "y1", "x2", "y2")
    assert 4 * sum(df.filter("i > 0").count() for df in sent if "i" in df.columns) < score.nested_pairs(turned, 0.7).count()
