"""Near boxes tied page by page in one pass, against brute force; no pair of boxes and no single page's Python call in the plan."""

import numpy as np
import pytest

from inkwell.operators import components, regions


def least(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize(("seed", "rows", "at_once"), [(1, 1 << 17, 1 << 20), (2, 40, 50), (3, 1, 1)])
def test_tied(spark, monkeypatch, seed, rows, at_once):
    monkeypatch.setattr(components, "ROWS", rows)
    monkeypatch.setattr(regions, "AT_ONCE", at_once)
    rng = np.random.default_rng(seed)
    boxes = []
    for page in range(-2, 7):
        made = sorted((int(rng.integers(0, 300)), int(rng.integers(-20, 300)), int(rng.integers(0, 40)), int(rng.integers(0, 30))) for _ in range(int(rng.integers(1, 90))))
        boxes += [(page, i, x, y, x + w, y + h, 4.5 * (page % 3), 7.25) for i, (y, x, w, h) in enumerate(made)]
    boxes += [(9, 0, 0, 0, 3000, 2, 1.0, 0.0), (9, 1, 2999, 1, 4000, 5, 1.0, 0.0), (9, 2, 3000, 3, 3000, 3, 1.0, 0.0)]
    table = spark.createDataFrame(boxes, "page_id int, seq int, x1 int, y1 int, x2 int, y2 int, v_gap double, h_gap double").repartition(3)
    want = []
    for page in {b[0] for b in boxes}:
        mine = [b for b in boxes if b[0] == page]
        near = [(a[1], b[1]) for a in mine for b in mine if a[1] < b[1] and b[3] - a[5] <= a[6] and max(a[2], b[2]) - min(a[4], b[4]) <= a[7]]
        want += [(page, b[1], b[1] + 1, k + 1) for b, k in zip(mine, least(len(mine), near))]
    got = regions.tied(table, ["y1", "x1", "seq"], "rank", "line").select("page_id", "seq", "rank", "line")
    # equal (y1, x1) go by seq, which is the order in which they were made
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "InPandas" not in plan and plan.count("Exchange") - plan.count("ReusedExchange") <= 2


def test_pages_stay_whole_above_a_join(spark):
    """A page's boxes lie in several tasks and come from a join by page, which Spark turns into a broadcast one while it runs."""
    rows = [(page, k, 30 * (k % 9), 20 * (k // 9), 30 * (k % 9) + 20, 20 * (k // 9) + 12) for k in range(45) for page in range(12)]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "page_id int, seq int, x1 int, y1 int, x2 int, y2 int")
    gaps = spark.createDataFrame([(page, 9.0, 12.0) for page in range(12)], "page_id int, v_gap double, h_gap double")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        got = spark.createDataFrame(regions.tied(table.join(gaps, "page_id"), ["y1", "x1", "seq"], "rank", "line").toPandas())
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert sorted((r.page_id, r.seq, r.rank, r.line) for r in got.collect()) == sorted((page, k, k + 1, 1) for page, k, *_ in rows)
    edges = regions.proximity_edges(got)
    near = [(a[1] + 1, b[1] + 1) for a in rows[::12] for b in rows[::12] if a[1] < b[1] and b[3] - a[5] <= 9 and max(a[2], b[2]) - min(a[4], b[4]) <= 12]
    assert sorted((r.page_id, r.a, r.b) for r in edges.collect()) == sorted((page, *pair) for page in range(12) for pair in near)


@pytest.mark.parametrize("scale", [1, 1 << 55])
def test_components(spark, monkeypatch, scale):
    monkeypatch.setattr(components, "ROWS", 60)
    rng = np.random.default_rng(4)
    nodes, edges, want = [], [], []
    for page in range(-3, 20):
        names = np.unique(rng.integers(0, 100, int(rng.integers(1, 30)))).tolist()
        pairs = [tuple(sorted(p)) for p in rng.integers(0, len(names), (int(rng.integers(0, 20)), 2)).tolist() if p[0] != p[1]]
        nodes += [(page, x * scale - 5) for x in names]
        edges += [(page, names[i] * scale - 5, names[j] * scale - 5) for i, j in pairs]
        want += [(page, x * scale - 5, names[k] * scale - 5) for x, k in zip(names, least(len(names), pairs))]
    got = components.components(spark.createDataFrame(nodes, "page_id int, node long"), spark.createDataFrame(edges, "page_id int, a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
